"""Symmetry groups on rasters and points: images, orbits, enforcement, error, detection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.operators.grid import Grid

#: Kind to the 2 by 2 matrices of its non-identity elements, about the middle.
ELEMENTS: dict[str, list[tuple[int, int, int, int]]] = {
    "none": [],
    "rotate180": [(-1, 0, 0, -1)],
    "mirrorX": [(-1, 0, 0, 1)],
    "mirrorZ": [(1, 0, 0, -1)],
    "diagonal": [(0, 1, 1, 0)],
    "antidiagonal": [(0, -1, -1, 0)],
    "quad": [(-1, 0, 0, 1), (1, 0, 0, -1), (-1, 0, 0, -1)],
    "rotate90": [(0, -1, 1, 0), (-1, 0, 0, -1), (0, 1, -1, 0)],
}
SQUARE_ONLY = ("diagonal", "antidiagonal", "rotate90")


def order(kind: str) -> int:
    return 1 + len(ELEMENTS[kind])


def applicable(kind: str, width: int, height: int) -> bool:
    return kind not in SQUARE_ONLY or width == height


def images(kind: str, x: Column, z: Column, width: int, height: int) -> Column:
    """Array of structs (x, z): a cell's images, the cell first.  Exact integer maps."""
    out = [F.struct(x.cast("long").alias("x"), z.cast("long").alias("z"))]
    for a, b, c, d in ELEMENTS[kind]:
        # 2 x' = a (2 x - w1) + b (2 z - h1) + w1, with w1 = width - 1, h1 = height - 1
        w1, h1 = width - 1, height - 1
        out.append(F.struct(
            ((x * 2 - w1) * a + (z * 2 - h1) * b + w1).cast("long").bitwiseAND(F.lit(-2)).alias("x2"),
            ((x * 2 - w1) * c + (z * 2 - h1) * d + h1).cast("long").bitwiseAND(F.lit(-2)).alias("z2"),
        ))
    half = [out[0], *[F.struct(F.shiftright(s["x2"], 1).alias("x"), F.shiftright(s["z2"], 1).alias("z")) for s in out[1:]]]
    return F.array(*half)


def orbits(grid: Grid, kind: str, v: str = "v", stride: int = 1) -> DataFrame:
    """x, z, v (of each ``stride``-th cell and row) and ``orbit``: the values of the distinct images that lie on the map, ordered by (z, x)."""
    w, h = grid.meta.width, grid.meta.height
    cells = grid.df if stride == 1 else grid.df.where((F.col("x") % stride == 0) & (F.col("z") % stride == 0))
    own = cells.select("x", "z", F.col(v).alias("v"), F.explode(F.array_distinct(images(kind, F.col("x"), F.col("z"), w, h))).alias("_i"))
    own = own.select("x", "z", "v", F.col("_i.x").alias("_x"), F.col("_i.z").alias("_z"))
    other = grid.df.select(F.col("x").alias("_x"), F.col("z").alias("_z"), F.col(v).alias("_v"))
    met = own.join(other, ["_x", "_z"])
    orbit = F.array_sort(F.collect_list(F.struct(F.col("_z").alias("z"), F.col("_x").alias("x"), F.col("_v").alias("v"))))
    return met.groupBy("x", "z", "v").agg(orbit.alias("orbit"))  # at most ``order(kind)`` entries


def enforce(grid: Grid, kind: str, mode: str = "average", strength: float = 1.0) -> DataFrame:
    """x, z, v with the orbit's average, max, min, first ("source") or last value."""
    o = F.transform("orbit", lambda s: s["v"])
    total = F.aggregate(o, F.lit(0.0), lambda a, b: a + b)
    value = {"average": total / F.size(o), "max": F.array_max(o), "min": F.array_min(o), "source": o[0], "last": o[F.size(o) - 1]}[mode]
    return orbits(grid, kind).select("x", "z", (F.col("v") + (value - F.col("v")) * strength).alias("v"))


def error_field(grid: Grid, kind: str) -> DataFrame:
    """x, z, worst deviation of a cell from its images."""
    worst = F.array_max(F.transform("orbit", lambda s: F.abs(s["v"] - F.col("v"))))
    return orbits(grid, kind).select("x", "z", worst.alias("deviation"))


def error(grid: Grid, kind: str, stride: int = 1) -> DataFrame:
    """rmse and largest deviation over all pairs of a cell and another image, and the share of cells with one."""
    pairs = orbits(grid, kind, stride=stride).select("x", "z", F.transform(F.filter("orbit", lambda s: (s["x"] != F.col("x")) | (s["z"] != F.col("z"))), lambda s: F.abs(s["v"] - F.col("v"))).alias("d"))
    flat = pairs.select("x", "z", F.explode_outer("d").alias("d"))
    return flat.agg(
        F.coalesce(F.sqrt(F.avg(F.col("d") * F.col("d"))), F.lit(0.0)).alias("rmse"), F.coalesce(F.max("d"), F.lit(0.0)).alias("max_deviation"),
    )


def detect(grid: Grid, kinds: Sequence[str] = tuple(ELEMENTS)) -> DataFrame:
    """Applicable kinds by rmse: kind, group order, rmse, confidence against the sample deviation."""
    parts, used = [], [k for k in kinds if ELEMENTS[k] and applicable(k, grid.meta.width, grid.meta.height)]
    spread = grid.df.agg(F.stddev_samp("v").alias("sd"))
    for place, kind in enumerate(used):
        parts.append(error(grid, kind).select(F.lit(kind).alias("kind"), F.lit(order(kind)).alias("order"), F.lit(place).alias("place"), "rmse"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - F.try_divide(F.col("rmse"), F.col("sd") * (2 ** 0.5))))
    return out.join(F.broadcast(spread)).select("kind", "order", "place", "rmse", F.coalesce(confidence, F.lit(1.0)).alias("confidence"))


def point_images(kind: str, x: Column, z: Column, world_x: float, world_z: float) -> Column:
    """Array of structs (x, z) of a point's images in world units, the point first."""
    cx, cz = world_x / 2, world_z / 2
    out = [F.struct(x.alias("x"), z.alias("z"))]
    for a, b, c, d in ELEMENTS[kind]:
        out.append(F.struct((F.lit(cx) + (x - cx) * a + (z - cz) * b).alias("x"), (F.lit(cz) + (x - cx) * c + (z - cz) * d).alias("z")))
    return F.array(*out)
