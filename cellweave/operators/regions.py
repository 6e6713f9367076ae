"""Connected regions of raster cells, with ids in row-major order of discovery.

Runs of a row are found by gaps and islands first, so a region is a graph of
runs and not of cells; runs of adjacent rows that touch are linked, and labels
settle by alternating star contraction, each round cut by ``checkpoint``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_CHECKPOINTS = "/tmp/checkpoints/cellweave"


def _settled(df: DataFrame) -> DataFrame:
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or DEFAULT_CHECKPOINTS)
    return df.checkpoint()


def runs(cells: DataFrame, width: int) -> DataFrame:
    """z, x0, x1 and ``run`` (linear index of the first cell) of maximal runs in rows."""
    island = F.col("x") - F.row_number().over(Window.partitionBy("z").orderBy("x"))
    found = cells.select("x", "z", island.alias("_i")).groupBy("z", "_i").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    return found.select("z", "x0", "x1", (F.col("z") * width + F.col("x0")).alias("run"))


def touching(found: DataFrame, diagonal: bool) -> DataFrame:
    """Links (a, b) of runs in adjacent rows that share a side (or a corner)."""
    reach = 1 if diagonal else 0
    below = found.select((F.col("z") - 1).alias("z"), F.col("x0").alias("y0"), F.col("x1").alias("y1"), F.col("run").alias("b"))
    meet = (F.col("x0") <= F.col("y1") + reach) & (F.col("y0") <= F.col("x1") + reach)
    return found.withColumnRenamed("run", "a").join(below, "z").where(meet).select("a", "b")


def contract(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (smallest node reachable) of every node of ``links``."""
    now = _settled(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = lambda d: d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = mark(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = _settled(small.unionByName(down.withColumnRenamed("m", "v")).distinct())
        new = mark(now)
        if new == seen:
            break
        seen = new
    else:
        raise RuntimeError(f"regions did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def rooted_runs(cells: DataFrame, width: int, diagonal: bool = False) -> DataFrame:
    """z, x0, x1, root of the runs of the set cells; ``root`` is the linear index of a region's first cell."""
    found = _settled(runs(cells, width))
    rooted = found.join(contract(touching(found, diagonal)), found["run"] == F.col("node"), "left")
    return rooted.select("z", "x0", "x1", F.coalesce("root", "run").alias("root"))


def region_stats(rooted: DataFrame, cell: float = 16.0) -> DataFrame:
    n = F.col("x1") - F.col("x0") + 1
    each = rooted.groupBy("root").agg(
        F.sum(n).alias("cell_count"), F.min("x0").alias("min_x"), F.min("z").alias("min_z"), F.max("x1").alias("max_x"), F.max("z").alias("max_z"),
        F.sum(n * (F.col("x0") + F.col("x1")) / 2.0).alias("_sx"), F.sum(n * F.col("z")).alias("_sz"),
    )
    return each.select(
        "root", "cell_count", (F.col("cell_count") * cell * cell).alias("area"), "min_x", "min_z", "max_x", "max_z",
        (F.col("_sx") / F.col("cell_count")).alias("centroid_x"), (F.col("_sz") / F.col("cell_count")).alias("centroid_z"),
    )


def regions(cells: DataFrame, width: int, diagonal: bool = False, cell: float = 16.0) -> DataFrame:
    """Statistics of every region of the set cells (x, z): root, cells, area, bounds, centroid.

    Roots are indices of first cells, so their order is that of discovery, row by row.
    """
    return region_stats(rooted_runs(cells, width, diagonal), cell)


def seeded(rooted: DataFrame, seeds: DataFrame) -> DataFrame:
    """root of the regions that hold a seed (x, z, in cells)."""
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") <= F.col("x1"))
    return rooted.join(seeds.select("x", "z"), "z").where(inside).select("root").distinct()


def largest(found: DataFrame) -> DataFrame:
    """root of the largest region (of equal ones the first found)."""
    return found.orderBy(F.desc("cell_count"), "root").limit(1).select("root")


def reached(found: DataFrame, at: DataFrame | None = None) -> DataFrame:
    """root of the regions that count as reached: those with seeds (``at``), or the largest where there are none."""
    main = largest(found)
    if at is None:
        return main
    none = at.agg((F.count(F.lit(1)) == 0).alias("none"))
    return at.unionByName(main.join(F.broadcast(none)).where("none").select("root"))


def pockets(found: DataFrame, least_area: float, at: DataFrame | None = None) -> DataFrame:
    """Regions that are not reached, of at least ``least_area``."""
    return found.join(reached(found, at), "root", "left_anti").where(F.col("area") >= least_area)


def reached_share(found: DataFrame, cells: int, at: DataFrame | None = None) -> DataFrame:
    """share: cells of the reached regions among all ``cells`` of the map."""
    kept = found.join(reached(found, at), "root", "left_semi")
    return kept.agg((F.coalesce(F.sum("cell_count"), F.lit(0)) / F.lit(float(max(cells, 1)))).alias("share"))
