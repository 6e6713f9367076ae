"""Resource rasters of bytes: painting spots, finding spots, tiles without repeats, plateaus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.operators.grid import Grid, GridMeta, blank
from cellweave.operators.regions import rooted_runs
from cellweave.operators.rules import METAL_SQUARE

#: The 21-cell blob: five by five without its corners, nearest cells first, then by row and column.
BLOB = sorted(((x, z) for x in range(-2, 3) for z in range(-2, 3) if abs(x) + abs(z) < 4), key=lambda p: (p[0] ** 2 + p[1] ** 2, p[1], p[0]))


def paint(spots: DataFrame, width: int, height: int, max_metal: float = 0.9, extracts: float = 0.001) -> DataFrame:
    """x, z, b of painted cells from spots (id, cx, cz, income); later ids overwrite earlier ones.

    A spot's bytes are shared evenly; what is left over goes one each to its nearest cells.
    """
    cells = F.array(*[F.struct(F.lit(x).alias("dx"), F.lit(z).alias("dz")) for x, z in BLOB])
    total = F.floor(F.col("income") / (extracts * max_metal) + 0.5)
    each = spots.select("id", "cx", "cz", total.alias("t"), F.posexplode(cells).alias("place", "c"))
    each = each.select("id", (F.col("cx") + F.col("c.dx")).alias("x"), (F.col("cz") + F.col("c.dz")).alias("z"), "place", "t")
    inside = each.where((F.col("x") >= 0) & (F.col("x") < width) & (F.col("z") >= 0) & (F.col("z") < height))
    w = Window.partitionBy("id")  # at most 21 rows
    n, rank = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy("place"))
    base = F.floor(F.col("t") / n)
    value = F.least(F.lit(255), base + F.when(rank <= F.col("t") - base * n, F.lit(1)).otherwise(F.lit(0)))
    painted = inside.select("id", "x", "z", value.cast("int").alias("b"))
    return painted.groupBy("x", "z").agg(F.max_by("b", "id").alias("b"))


def find_spots(cells: DataFrame, width: int, height: int, max_metal: float = 0.9, extracts: float = 0.001, radius: float = 90.0) -> DataFrame:
    """Spots of a byte raster (x, z, b): eight-connected set cells without the one-cell border.

    x, z are the middle of a spot's box; a spot wider than twice the extractors' radius is not capturable.
    """
    k = F.col
    inner = cells.where((k("b") > 0) & (k("x") > 0) & (k("z") > 0) & (k("x") < width - 1) & (k("z") < height - 1))
    rooted = rooted_runs(inner.select("x", "z"), width, True)
    each = rooted.select(k("root").alias("spot"), "z", F.explode(F.sequence("x0", "x1")).alias("x")).join(inner, ["x", "z"])
    at = METAL_SQUARE
    box = each.groupBy("spot").agg(
        (F.sum("b") * max_metal).alias("worth"), F.count(F.lit(1)).alias("cell_count"),
        (F.min("x") * at).alias("min_x"), (F.min("z") * at).alias("min_z"), ((F.max("x") + 1) * at).alias("max_x"), ((F.max("z") + 1) * at).alias("max_z"),
    )
    extent = F.greatest(k("max_x") - k("min_x"), k("max_z") - k("min_z"))
    return box.select(
        "spot", ((k("min_x") + k("max_x")) / 2).alias("x"), ((k("min_z") + k("max_z")) / 2).alias("z"), "worth", (k("worth") * extracts).alias("income"),
        "cell_count", "min_x", "min_z", "max_x", "max_z", extent.alias("extent"), (extent <= 2 * radius).alias("capturable"),
    )


def is_resource_map(spots: DataFrame, radius: float = 90.0) -> DataFrame:
    """One row: the widest spot, and whether one is so wide (six radii) that the raster is an even deposit."""
    return spots.agg(F.coalesce(F.max("extent"), F.lit(0.0)).alias("largest")).select("largest", (F.col("largest") > 6 * radius).alias("even"))


def density(b: Column, max_metal: float = 0.9) -> Column:
    return b * max_metal


def distinct_tiles(tiles: DataFrame) -> DataFrame:
    """pos, tile_id of tiles (pos, data): equal tiles share an id; ids follow first positions."""
    first = tiles.groupBy(F.sha2("data", 256).alias("digest")).agg(F.min("pos").alias("first"))
    return tiles.select("pos", F.sha2("data", 256).alias("digest")).join(first, "digest").select("pos", "first")


def plateaus(spark: SparkSession, meta: GridMeta, sites: Sequence[tuple[float, float, float, float]], sharpness: float = 0.0) -> Grid:
    """Discs (centre x, z, radius in samples, height); the strongest wins, the first of equals; and ``mask``."""
    grid = blank(spark, meta)
    power = 1 / max(0.05, 1 - sharpness * 0.95)
    weights = []
    for n, (cx, cz, r, h) in enumerate(sites):
        d = F.hypot((F.col("x") - cx) / r, (F.col("z") - cz) / r)
        edge = F.pow(F.greatest(F.lit(0.0), F.lit(1.0) - d), F.lit(power))
        weights.append((n, h, edge))
        grid = grid.with_column(f"_e{n}", edge)
    for n, h, _ in weights:
        e = F.col(f"_e{n}")
        w = e * e * (F.lit(3.0) - e * 2)
        one = F.struct(F.abs(w * h).alias("s"), F.lit(-n).alias("o"), (w * h).alias("v"), w.alias("w"))
        grid = grid.with_column(f"_s{n}", one)
    chosen = F.greatest(*[F.col(f"_s{n}") for n, _, _ in weights]) if len(weights) > 1 else F.col("_s0")
    mask = F.greatest(*[F.col(f"_s{n}")["w"] for n, _, _ in weights], F.lit(0.0))
    return Grid(grid.df.select("x", "z", chosen["v"].alias("v"), mask.alias("mask")), meta)
