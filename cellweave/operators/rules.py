"""Spatial rules on corner heights: slope cells, passability, building sites, resources, start areas."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.operators.grid import Grid, along_x, along_z, in_tiles
from cellweave.operators.stencil import _centres, _extrema, square_centres

# Fixed values of the rules.
SQUARE = 8.0
METAL_SQUARE = 16.0
BANDS = [("vehicle", 27.0), ("hover", 33.0), ("bot", 54.0), ("allterrain", 90.0)]
#: id, family, footprint, slope limit (degrees), slope modifier, least and greatest water depth, crush strength.
MOVE_CLASSES = [
    ("COMMANDERBOT", "kbot", 3, 54, 4.0, 0, 5000, 50), ("SBOT2", "kbot", 2, 54, 4.0, 0, 5, 5),
    ("BOT2", "kbot", 2, 54, 4.0, 0, 20, 15), ("BOT3", "kbot", 3, 54, 4.0, 0, 20, 25),
    ("HBOT4", "kbot", 4, 54, 4.0, 0, 20, 252), ("HBOT7", "kbot", 7, 54, 4.0, 0, 20, 1400),
    ("HTBOT6", "kbot", 6, 90, 4.0, 0, 20, 252), ("ABOT3", "kbot", 3, 54, 4.0, 0, 5000, 50),
    ("HABOT5", "kbot", 5, 54, 4.0, 0, 5000, 252), ("VBOT6", "kbot", 6, 54, 4.0, 0, 5000, 1400),
    ("TBOT3", "kbot", 3, 90, 4.0, 0, 20, 15), ("NANO", "kbot", 3, 27, 36.4, 0, 0, 0),
    ("TANK2", "tank", 2, 27, 18.0, 0, 20, 18), ("TANK3", "tank", 3, 27, 18.0, 0, 20, 30),
    ("MTANK3", "tank", 3, 27, 25.0, 0, 20, 250), ("HTANK4", "tank", 4, 27, 36.0, 0, 20, 252),
    ("HTANK7", "tank", 7, 33, 42.0, 0, 20, 1400), ("ATANK3", "tank", 3, 54, 18.0, 0, 5000, 30),
    ("HOVER2", "hover", 2, 33, 25.0, 0, 9999, 25), ("HOVER3", "hover", 3, 33, 25.0, 0, 9999, 25),
    ("HHOVER4", "hover", 4, 33, 18.0, 0, 9999, 252), ("AHOVER2", "hover", 2, 54, 18.0, 0, 9999, 25),
    ("BOAT3", "ship", 3, 90, 0.0, 8, 9999, 9), ("BOAT4", "ship", 4, 90, 0.0, 8, 9999, 9),
    ("BOAT5", "ship", 5, 90, 0.0, 8, 9999, 16), ("BOAT9", "ship", 9, 90, 0.0, 15, 9999, 252),
    ("UBOAT4", "ship", 4, 90, 0.0, 15, 9999, 5), ("EPIC5", "kbot", 5, 54, 4.0, 0, 9999, 9999),
]
#: id, footprint (x, z), slope limit (degrees).
BUILDINGS = [
    ("llt", 2, 2, 14), ("radar", 2, 2, 14), ("wind", 3, 3, 10), ("nano", 3, 3, 10), ("mex", 4, 4, 30),
    ("annihilator", 4, 4, 10), ("bertha", 4, 4, 12), ("solar", 5, 5, 10), ("geo", 5, 5, 20), ("advgeo", 5, 5, 15),
    ("fusion", 6, 5, 10), ("lab", 6, 6, 15), ("vulcan", 8, 8, 10),
]


def slope_value(degrees: float) -> float:
    return 1 - math.cos(math.radians(degrees))


def slope_value_to_degrees(v: Column) -> Column:
    return F.degrees(F.acos(F.lit(1.0) - v))


def max_height_dif(degrees: float) -> float:
    return 40 * math.tan(math.radians(degrees))


def move_classes(spark: SparkSession) -> DataFrame:
    """The move classes with derived columns."""
    rows = [
        (i, fam, fp, 2 * fp - 1, (2 * fp - 1) * SQUARE, float(deg), slope_value(deg), mod, float(lo), float(hi), i == "UBOAT4", crush, fam == "ship" or deg >= 90, fam == "hover")
        for i, fam, fp, deg, mod, lo, hi, crush in MOVE_CLASSES
    ]
    return spark.createDataFrame(
        rows,
        "id string, family string, footprint int, xsize int, path_width double, max_slope_degrees double, max_slope_value double, slope_mod double, "
        "min_water_depth double, max_water_depth double, submersible boolean, crush_strength int, ignores_slope boolean, ignores_depth boolean",
    )


def slope_band(degrees: Column) -> Column:
    out = F.when(degrees <= BANDS[0][1], F.lit(BANDS[0][0]))
    for name, most in BANDS[1:]:
        out = out.when(degrees <= most, F.lit(name))
    return out


def slope_cells(corners: Grid, v: str = "v") -> DataFrame:
    """cx, cz, slope, lo, hi of every 2 by 2 block of squares (lo, hi: of its 3 by 3 corners).

    A block lies in one tile, so its sums need no further shuffle.
    """
    rows = in_tiles(corners, 2, lambda g: _slope_cells(g, v))
    return rows.select("cx", "cz", "slope", "lo", "hi")


def _slope_cells(corners: Grid, v: str) -> DataFrame:
    k = F.col
    rows = corners.df.select("_tx", "_tz", "x", "z", k(v).alias("tl")).withColumn("tr", F.lead("tl").over(along_x()))
    rows = rows.withColumns({"bl": F.lead("tl").over(along_z()), "br": F.lead("tr").over(along_z())})
    rows = rows.where("tr is not null and br is not null")
    a, b, c, d = k("tr") - k("tl"), k("bl") - k("tl"), k("bl") - k("br"), k("tr") - k("br")
    square2 = SQUARE * SQUARE
    rows = rows.withColumns({
        "n1": F.lit(SQUARE) / F.sqrt(a * a + square2 + b * b), "n2": F.lit(SQUARE) / F.sqrt(c * c + square2 + d * d),
        "lo": F.least("tl", "tr", "bl", "br"), "hi": F.greatest("tl", "tr", "bl", "br"),
    })
    cells = rows.groupBy("_tx", "_tz", F.floor(k("x") / 2).alias("cx"), F.floor(k("z") / 2).alias("cz")).agg(
        (F.sum(k("n1") + k("n2")) * 0.125).alias("avg"), F.min(F.least("n1", "n2")).alias("low"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count(F.lit(1)).alias("squares"),
    ).where("squares = 4")
    slope = F.lit(1.0) - (k("low") + (k("avg") - k("low")) * (k("low") / k("avg")))
    return cells.select("_tx", "_tz", "cx", "cz", slope.alias("slope"), "lo", "hi", (k("cx") * 2).alias("x"), (k("cz") * 2).alias("z"))


def passable(water: float = 0.0) -> Column:
    """Whether a slope cell lets a move class pass; columns of both tables on one row."""
    k = F.col
    steep = k("ignores_slope") | (k("slope") <= k("max_slope_value"))
    return (
        F.when(k("family") == "ship", F.lit(water) - k("hi") >= k("min_water_depth"))
        .when(k("ignores_depth"), (k("hi") < water) | steep)
        .otherwise(steep & (F.lit(water) - k("lo") <= k("max_water_depth")))
    )


def passability(cells: DataFrame, water: float = 0.0) -> DataFrame:
    """One column of 0/1 per move class would widen rows; classes (28 rows) are broadcast instead."""
    classes = move_classes(cells.sparkSession)
    return cells.join(F.broadcast(classes)).withColumn("passable", passable(water).cast("int"))


def buildability(corners: Grid, sx: int, sz: int, tolerance: float, water: float = 0.0, max_depth: float | None = None, v: str = "v") -> DataFrame:
    """x, z, fits of every footprint of ``sx`` by ``sz`` squares, keyed by its first square."""
    ok = (F.col("hi") - F.col("_p") <= tolerance) & (F.col("_p") - F.col("lo") <= tolerance)
    if max_depth is not None:
        ok &= F.lit(water) - F.col("lo") <= max_depth

    def run(g: Grid) -> DataFrame:
        rows = _centres(g, v)
        rows = rows.with_column("_p", F.lead("v", sx // 2).over(along_x()) if sx > 1 else F.col("v"))
        rows = rows.with_column("_p", F.lead("_p", sz // 2).over(along_z()) if sz > 1 else F.col("_p"))
        return _extrema(rows, sx, sz, "v").select("_tx", "_tz", "x", "z", ok.cast("int").alias("fits"))

    return in_tiles(corners, max(sx, sz), run)


def income(cells: DataFrame, spots: DataFrame, radius: float = 90.0, max_metal: float = 0.9, extracts: float = 0.001) -> DataFrame:
    """Income of extractors (id, px, pz) over resource cells (x, z, b); the disc is open at its rim.

    Cells and spots meet by buckets of the disc's diameter, an equi-join.
    """
    size = 2 * radius
    at = cells.select(((F.col("x") + 0.5) * METAL_SQUARE).alias("mx"), ((F.col("z") + 0.5) * METAL_SQUARE).alias("mz"), "b")
    at = at.withColumns({"_bx": F.floor(F.col("mx") / size), "_bz": F.floor(F.col("mz") / size)})
    near = spots.withColumns({"_ox": F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)]))}).withColumn("_oz", F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)])))
    near = near.select("id", "px", "pz", (F.floor(F.col("px") / size) + F.col("_ox")).alias("_bx"), (F.floor(F.col("pz") / size) + F.col("_oz")).alias("_bz"))
    d = (F.col("mx") - F.col("px")) * (F.col("mx") - F.col("px")) + (F.col("mz") - F.col("pz")) * (F.col("mz") - F.col("pz"))
    sums = near.join(at, ["_bx", "_bz"]).where(d < radius * radius).groupBy("id").agg(F.sum("b").alias("total"))
    return spots.select("id").join(sums, "id", "left").select("id", (F.coalesce("total", F.lit(0)) * max_metal * extracts).alias("income"))


def balance(spots: DataFrame, starts: Sequence[tuple[float, float]], contested: float = 0.15, base_radius: float = 1200.0) -> DataFrame:
    """Per start: spot count, income, base income, nearest spot; contested spots belong to nobody.

    Starts are a parameter (a few players), so distances are columns and not a join.
    """
    k = F.col
    apart = [F.hypot(k("x") - float(x), k("z") - float(z)) for x, z in starts]
    rows = spots.withColumn("_d", F.array(*apart)).withColumn("_o", F.array_sort(F.arrays_zip(k("_d").alias("d"), F.array(*[F.lit(i) for i in range(len(starts))]).alias("i"))))
    first, second = k("_o")[0]["d"], k("_o")[1]["d"] if len(starts) > 1 else F.lit(None).cast("double")
    lead = F.when(second > 0, (second - first) / second).otherwise(F.lit(0.0))
    rows = rows.select("income", "_d", k("_o")[0]["i"].alias("best"), first.alias("near"), F.coalesce(second.isNotNull() & (lead < contested), F.lit(False)).alias("shared"))
    each = rows.select(F.posexplode("_d").alias("player", "d"), "income", "best", "near", "shared")
    mine = (k("best") == k("player")) & ~k("shared")
    return each.groupBy("player").agg(
        F.count(F.when(mine, 1)).alias("spots"), F.coalesce(F.sum(F.when(mine, k("income"))), F.lit(0.0)).alias("income"),
        F.coalesce(F.sum(F.when(mine & (k("near") <= base_radius), k("income"))), F.lit(0.0)).alias("base_income"), F.min("d").alias("nearest"),
    )


def start_boxes(starts: DataFrame, world_x: float, world_z: float) -> DataFrame:
    """Per team: bounding box with a margin, in the 0..200 space."""
    grow = lambda size: min(900.0, 0.16 * size)
    to = lambda c, size: F.greatest(F.lit(0), F.least(F.lit(200), F.floor(c / size * 200 + 0.5)))
    gx, gz = grow(world_x), grow(world_z)
    return starts.groupBy("team").agg(
        to(F.min("x") - gx, world_x).alias("left"), to(F.min("z") - gz, world_z).alias("top"),
        to(F.max("x") + gx, world_x).alias("right"), to(F.max("z") + gz, world_z).alias("bottom"),
    )


def terrain_type(height: Column, slope_degrees: Column) -> Column:
    """0 ground, 1 rock, 2 sand, 3 water."""
    return F.when(height < 0, F.lit(3)).when(slope_degrees > 27, F.lit(1)).when(height < 12, F.lit(2)).otherwise(F.lit(0))


def largest_footprint(corners: Grid, tolerance: float, most: int = 8) -> DataFrame:
    """x, z, world size of the largest square footprint that fits at each square (0: none)."""
    out = square_centres(corners).df.select("x", "z", F.lit(0.0).alias("size"))
    for fp in range(1, most + 1):
        fits = buildability(corners, 2 * fp, 2 * fp, tolerance).where("fits = 1").select("x", "z", F.lit(fp * 2 * SQUARE).alias("_s"))
        out = out.join(fits, ["x", "z"], "left").select("x", "z", F.coalesce("_s", "size").alias("size"))
    return out


def land(cells: DataFrame, water: float = 0.0) -> DataFrame:
    """Slope cells whose highest corner is not below the water."""
    return cells.where(F.col("hi") >= water)


def passable_by(cells: DataFrame, classes: Sequence[str], water: float = 0.0) -> DataFrame:
    """``cells`` with one 0/1 column a class: conditions in place of rows."""
    known = {c[0]: c for c in MOVE_CLASSES}
    out = {}
    for name in classes:
        _, family, _, degrees, _, least, most, _ = known[name]
        steep = F.lit(True) if family == "ship" or degrees >= 90 else F.col("slope") <= slope_value(degrees)
        dry = F.lit(water) - F.col("lo") <= float(most)
        ok = F.lit(water) - F.col("hi") >= float(least) if family == "ship" else (F.col("hi") < water) | steep if family == "hover" else steep & dry
        out[name] = ok.cast("int")
    return cells.withColumns(out)


def slope_band_of_value(v: Column) -> Column:
    return slope_band(slope_value_to_degrees(v))


def buildings(spark: SparkSession) -> DataFrame:
    """Footprints and the height difference that each building tolerates."""
    rows = [(n, x, z, 2 * x, 2 * z, float(d), max_height_dif(d)) for n, x, z, d in BUILDINGS]
    return spark.createDataFrame(rows, "id string, footprint_x int, footprint_z int, squares_x int, squares_z int, max_slope_degrees double, max_height_dif double")


def building(name: str) -> tuple[int, float]:
    """Squares a side and tolerance of a building."""
    found = {n: (2 * x, max_height_dif(d)) for n, x, _, d in BUILDINGS}
    if name not in found:
        raise KeyError(f"unknown building {name}")
    return found[name]


def count_placements(fits: DataFrame, squares: int, near: DataFrame | None = None, radius: float = float("inf"), limit: int | None = None) -> DataFrame:
    """How many footprints can be placed side by side: rows of ``squares`` are filled from the west.

    ``fits``: x, z, fits.  With ``near`` (id, px, pz) per point, middles within ``radius`` (one row a point, also without any).
    """
    rows = fits.where((F.col("fits") > 0) & (F.col("z") % squares == 0))
    key = []
    if near is not None:
        key = ["id"]
        dx, dz = (F.col("x") + squares / 2) * SQUARE - F.col("px"), (F.col("z") + squares / 2) * SQUARE - F.col("pz")
        size = 2 * radius
        at = rows.withColumns({"_bx": F.floor((F.col("x") + squares / 2) * SQUARE / size), "_bz": F.floor((F.col("z") + squares / 2) * SQUARE / size)})
        step = F.array(*[F.lit(i) for i in (-1, 0, 1)])
        who = near.select("id", "px", "pz", F.explode(step).alias("_i")).withColumn("_j", F.explode(step))
        who = who.select("id", "px", "pz", (F.floor(F.col("px") / size) + F.col("_i")).alias("_bx"), (F.floor(F.col("pz") / size) + F.col("_j")).alias("_bz"))
        rows = who.join(at, ["_bx", "_bz"]).where(dx * dx + dz * dz <= radius * radius)
    row = rows.groupBy(*key, "z").agg(F.array_sort(F.collect_list("x")).alias("xs"))  # one row of the map
    start = F.struct(F.lit(-1).cast("long").alias("free"), F.lit(0).alias("n"))
    taken = F.aggregate("xs", start, lambda s, x: F.when(x >= s["free"], F.struct((x + squares).cast("long").alias("free"), (s["n"] + 1).alias("n"))).otherwise(s))["n"]
    counted = row.select(*key, taken.alias("n")).groupBy(*key).agg(F.sum("n").alias("placed"))
    if near is not None:
        counted = near.select("id").join(counted, "id", "left")
    placed = F.coalesce("placed", F.lit(0))
    return counted.select(*key, (F.least(placed, F.lit(limit)) if limit else placed).cast("long").alias("placed"))
