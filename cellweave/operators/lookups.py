"""Dimension tables of distances, speeds and map sizes, and lighting arithmetic."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions.numeric import clamp01

# Id, world units, kind.
DISTANCES = [
    ("square", 8, "grid"), ("metalCell", 16, "grid"), ("radarCell", 32, "grid"), ("losCell", 64, "grid"), ("extractorRadius", 90, "resource"),
    ("comBuild", 145, "build"), ("pawn", 180, "weapon"), ("comDgun", 250, "weapon"), ("comLaser", 300, "weapon"), ("stumpy", 350, "weapon"),
    ("thud", 380, "weapon"), ("nanoBuild", 400, "build"), ("llt", 430, "weapon"), ("comSight", 450, "vision"), ("rocko", 475, "weapon"),
    ("hlt", 620, "weapon"), ("fido", 650, "weapon"), ("comRadar", 700, "vision"), ("luger", 710, "weapon"), ("pitbull", 730, "weapon"),
    ("doomsday", 950, "weapon"), ("merl", 1300, "weapon"), ("ambusher", 1380, "weapon"), ("annihilator", 1400, "weapon"), ("anniRadar", 1500, "vision"),
    ("radar", 2100, "vision"), ("bertha", 4650, "weapon"), ("vulcan", 5750, "weapon"),
]
# Id, world units a second.
SPEEDS = [
    ("armcom", 37.5), ("armmerl", 33.0), ("corgol", 39.0), ("corthud", 45.0), ("armham", 46.2), ("armrock", 50.7), ("armfido", 69.0), ("armstump", 75.0),
    ("armpw", 87.0), ("armfig", 289.0),
]
# Size in units, maps of that size, least and most players.
SIZES = [
    (8, 8, 6, 2, 6), (10, 10, 7, 2, 4), (12, 12, 12, 2, 8), (14, 14, 14, 2, 8), (16, 16, 36, 2, 16), (18, 18, 8, 4, 16), (20, 16, 9, 8, 16),
    (20, 20, 21, 8, 16), (24, 16, 7, 12, 16), (24, 24, 21, 12, 16), (28, 28, 4, 4, 16), (32, 32, 5, 10, 32),
]
SIDE_MULTIPLE, UNIT_SQUARES = 128, 64
# Fixed values of the lighting model.
AMBIENT, DIFFUSE, SHADOW_DENSITY, SUN = (0.4, 0.4, 0.4), (0.9, 0.9, 0.85), 0.85, (0.8, 1.0, -0.7)
INTENSITY = 0.823486328125


def distances(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, float(d), k) for i, d, k in DISTANCES], "id string, distance double, kind string")


def speeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SPEEDS, "id string, per_second double")


def map_sizes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SIZES, "size_x int, size_z int, maps int, least_players int, most_players int")


def travel_seconds(distance: Column, unit: str = "armstump") -> Column:
    known = dict(SPEEDS)
    if unit not in known:
        raise KeyError(f"unknown unit {unit}")
    return distance / known[unit]


def recommended_sizes(spark: SparkSession, players: int) -> DataFrame:
    return map_sizes(spark).where((F.col("least_players") <= players) & (F.col("most_players") >= players))


def legal_side(squares: Column) -> Column:
    return (squares > 0) & (squares % SIDE_MULTIPLE == 0)


def size_units(squares: Column) -> Column:
    return squares / UNIT_SQUARES


def flat_light(sun: Sequence[float] = SUN) -> float:
    """Cosine between the sun and a flat ground."""
    size = math.sqrt(sum(c * c for c in sun[:3]))
    return min(1.0, max(0.0, sun[1] / size)) if size else 0.0


def ground_shade(light: Column, seen: Column | None = None, ambient: Sequence[float] = AMBIENT, diffuse: Sequence[float] = DIFFUSE, density: float = SHADOW_DENSITY) -> list[Column]:
    """The factors that the ground's red, green and blue are multiplied by."""
    seen = F.lit(1.0) if seen is None else seen
    lit = F.lit(1.0) - (F.lit(1.0) - clamp01(seen)) * density
    return [(F.lit(float(a)) + clamp01(light) * lit * float(d)) * INTENSITY for a, d in zip(ambient, diffuse)]


def peak_shade(ambient: Sequence[float] = AMBIENT, diffuse: Sequence[float] = DIFFUSE) -> float:
    return max((a + d) * INTENSITY for a, d in zip(ambient, diffuse))


def sun_angles(sun: Sequence[float] = SUN) -> tuple[float, float]:
    """Compass azimuth and altitude (degrees) of the direction that light comes from; north is -z."""
    x, y, z = sun[:3]
    return math.degrees(math.atan2(x, -z)) % 360, math.degrees(math.atan2(y, math.hypot(x, z)))
