"""Map checks: issue rows (severity, code, x, z) from aggregates and small self-joins."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.operators import symmetry
from cellweave.operators.grid import Grid
from cellweave.operators.lookups import SIDE_MULTIPLE, UNIT_SQUARES
from cellweave.operators.regions import largest, pockets, region_stats, rooted_runs, seeded
from cellweave.operators.rules import METAL_SQUARE, MOVE_CLASSES, SQUARE, building, count_placements, land, passable_by

# Fixed values of the checks.
CLASSES = ("TANK3", "BOT2", "HOVER3", "BOAT4")
CROSSABLE, LEAST_POCKET, LISTED, PADS = 0.75, 400.0 * 400.0, 3, 25
#: Starts of a bucket that one task compares; rows that one task repeats at a time.
CHUNK, RUN = 512, 65_536
#: Severities in the order of a report.
SEVERITY = ("error", "warning", "info")


def _issue(severity: Column | str, code: str, x: Column | None = None, z: Column | None = None) -> Column:
    level = F.lit(severity) if isinstance(severity, str) else severity
    place = [F.lit(None).cast("double") if c is None else c.cast("double") for c in (x, z)]
    return F.struct(level.alias("severity"), F.lit(code).alias("code"), place[0].alias("x"), place[1].alias("z"))


def _rows(df: DataFrame, found: list[Column]) -> DataFrame:
    one = df.select(F.explode(F.filter(F.array(*found), lambda i: i.isNotNull())).alias("i"))
    return one.select("i.severity", "i.code", "i.x", "i.z")


def check_size(df: DataFrame, mapx: int, mapz: int, players: int = 0, most: float = 32.0) -> DataFrame:
    """One row in: legal sides are positive multiples of 128 squares; area in units of 64 squares for each player."""
    units = mapx / UNIT_SQUARES, mapz / UNIT_SQUARES
    area = units[0] * units[1] / players if players >= 2 else None
    sprawling = area is not None and players >= 8 and area > 45
    found = [
        *[("error", "size.dimension") for n in (mapx, mapz) if n <= 0 or n % SIDE_MULTIPLE], *[("error", "size.tooLarge")] * (max(units) > most),
        *[("warning", "size.tooSmall")] * (min(units) < 6), *[("warning", "size.sprawling")] * sprawling,
        *[("warning", "size.cramped")] * (area is not None and not sprawling and area < 12),
    ]
    return _rows(df.limit(1), [_issue(level, code) for level, code in found] or [F.lit(None).cast("struct<severity:string,code:string,x:double,z:double>")])


def check_slopes(cells: DataFrame, water: float = 0.0) -> DataFrame:
    """Shares of the land that vehicles and bots can use (slope cells)."""
    ground = passable_by(land(cells, water), ("TANK3", "BOT2"), water)
    one = ground.agg(F.count(F.lit(1)).alias("n"), F.avg("TANK3").alias("vehicle"), F.avg("BOT2").alias("bot"))
    some, vehicle = F.col("n") > 0, F.col("vehicle")
    return _rows(one, [
        F.when(~some, _issue("warning", "slope.noLand")), F.when(some, _issue("info", "slope.distribution")),
        F.when(some & (vehicle < 0.6), _issue(F.when(vehicle < 0.4, F.lit("error")).otherwise(F.lit("warning")), "slope.vehicleBand")),
        F.when(some & (F.col("bot") < 0.85), _issue("warning", "slope.botBand")),
    ])


def check_reachability(cells: DataFrame, width: int, classes: Sequence[str] = CLASSES, seeds: DataFrame | None = None, water: float = 0.0) -> DataFrame:
    """Regions that a move class cannot leave; ``seeds``: px, pz of start positions.  Columns: those of issues and ``class``."""
    families = {c[0]: c[1] for c in MOVE_CLASSES}
    by_class, out = passable_by(cells, classes, water), None
    at = None if seeds is None else seeds.select(F.floor(F.col("px") / METAL_SQUARE).alias("x"), F.floor(F.col("pz") / METAL_SQUARE).alias("z"))
    for name in classes:
        family, ground = families[name], families[name] not in ("ship", "hover")
        rooted = rooted_runs(by_class.where(F.col(name) > 0).select(F.col("cx").alias("x"), F.col("cz").alias("z")), width)
        found = region_stats(rooted)
        roots = None if at is None else seeded(rooted, at)
        total = found.agg(F.coalesce(F.sum("cell_count"), F.lit(0)).alias("all"), F.coalesce(F.max("cell_count"), F.lit(0)).alias("most"))
        others = found.join(largest(found), "root", "left_anti").where(F.col("area") >= LEAST_POCKET)
        first = others.orderBy(F.desc("area"), "root").limit(1).select("centroid_x", "centroid_z")
        severed = total.join(F.broadcast(first)).select("centroid_x", "centroid_z", (F.lit(ground) & (F.col("most") / F.col("all") < CROSSABLE)).alias("cut")).where("cut")
        whole = severed.agg((F.count(F.lit(1)) == 0).alias("whole"))
        left = pockets(found, LEAST_POCKET, roots).join(F.broadcast(whole)).where("whole")
        # The few largest one by one, and one issue for the rest.
        top = left.orderBy(F.desc("area"), "root").limit(LISTED + 1)
        middle = lambda c: (F.col(c) + 0.5) * METAL_SQUARE
        parts = [
            _rows(total, [F.when((F.col("all") == 0) & F.lit(family != "ship"), _issue("warning", "pathing.noTerrain"))]),
            _rows(severed, [_issue("warning", "pathing.severed", middle("centroid_x"), middle("centroid_z"))]),
            _rows(top, [_issue("warning", "pathing.pocket", middle("centroid_x"), middle("centroid_z"))]),
        ]
        if roots is not None and family != "ship":
            parts.append(_rows(roots.agg(F.count(F.lit(1)).alias("n")), [F.when(F.col("n") > 1, _issue("error", "pathing.startsDisconnected"))]))
        for p in parts:
            p = p.withColumn("class", F.lit(name))
            out = p if out is None else out.unionByName(p)
    return out


def check_pads(lab: DataFrame, solar: DataFrame, starts: DataFrame, radius: float = 600.0) -> DataFrame:
    """Room near each start (id, px, pz) for factories and for the buildings of a base (``lab``, ``solar``: x, z, fits)."""
    labs = count_placements(lab, building("lab")[0], starts, radius, 8).withColumnRenamed("placed", "labs")
    pads = count_placements(solar, building("solar")[0], starts, radius, PADS + 1).withColumnRenamed("placed", "pads")
    rows, x, z = starts.join(labs, "id").join(pads, "id"), F.col("px"), F.col("pz")
    return _rows(rows, [
        F.when(F.col("labs") < 3, _issue(F.when(F.col("labs") == 0, F.lit("error")).otherwise(F.lit("warning")), "build.labPad", x, z)),
        F.when(F.col("pads") < PADS, _issue("warning", "build.basePad", x, z)),
    ])


def check_symmetry(grid: Grid, kind: str, starts: Sequence[tuple[float, float]] = (), stride: int | None = None) -> DataFrame:
    """How far heights and starts (a parameter of a few points) are off the declared symmetry."""
    if kind == "none":
        return _rows(grid.df.limit(0), [_issue("info", "symmetry.none")])
    if not symmetry.applicable(kind, grid.meta.width, grid.meta.height):
        return _rows(grid.df.agg(F.count(F.lit(1)).alias("n")), [_issue("error", "symmetry.inapplicable")])
    step = stride or (8 if grid.meta.width > 64 else 1)
    off = symmetry.error(grid, kind, step)
    span = grid.df.agg(F.greatest(F.max("v") - F.min("v"), F.lit(1e-6)).alias("relief"))
    share = F.col("max_deviation") / F.col("relief")
    out = _rows(off.join(F.broadcast(span)), [F.when(share > 0.02, _issue(F.when(share > 0.1, F.lit("error")).otherwise(F.lit("warning")), "symmetry.height"))])
    world = grid.meta.cell * (grid.meta.width - 1), grid.meta.cell * (grid.meta.height - 1)
    if len(starts) > 1:
        here = grid.df.sparkSession.createDataFrame([(float(x), float(z)) for x, z in starts], "x double, z double")
        image = here.select(F.explode(F.slice(symmetry.point_images(kind, F.col("x"), F.col("z"), *world), 2, 99)).alias("p")).select("p.x", "p.z")
        nearest = F.least(*[F.hypot(F.col("x") - float(x), F.col("z") - float(z)) for x, z in starts])
        lost = image.where(F.col("x").between(0, world[0]) & F.col("z").between(0, world[1]) & (nearest > 8 * METAL_SQUARE))
        out = out.unionByName(_rows(lost, [_issue("warning", "symmetry.starts", F.col("x"), F.col("z"))]))
    return out


def check_heights(heights: DataFrame, low: float | None, high: float | None, v: str = "v") -> DataFrame:
    stats = heights.agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    if low is None or high is None:
        return _rows(stats, [_issue("warning", "height.undeclared")])
    if low >= high:
        return _rows(stats, [_issue("error", "height.inverted")])
    declared, relief = high - low, F.col("hi") - F.col("lo")
    step = declared / 65536
    tilt = F.degrees(F.atan(F.lit(step / SQUARE)))
    return _rows(stats, [
        F.when((F.lit(low) - F.col("lo") > step) | (F.col("hi") - high > step), _issue("error", "height.clipped")),
        F.when(relief / declared < 0.2, _issue(F.when(tilt >= 0.25, F.lit("warning")).otherwise(F.lit("info")), "height.rangeWaste")),
        F.when(tilt >= 2, _issue("error", "height.terracing")),
        F.when(relief < 100, _issue("info", "height.flat")),
    ])


def check_water(heights: DataFrame, level: float = 0.0, v: str = "v") -> DataFrame:
    depth = F.lit(level) - F.col(v)
    stats = heights.agg(
        F.count(F.lit(1)).alias("all"), F.count_if(depth > 0).alias("wet"), F.count_if((depth >= 1) & (depth < 8)).alias("dead"), F.max(depth).alias("deepest")
    )
    wet, deepest = F.col("wet"), F.col("deepest")
    return _rows(stats, [
        F.when(wet == 0, _issue("info", "water.none")),
        F.when((wet > 0) & (deepest < 8), _issue("warning", "water.tooShallow")),
        F.when((wet > 0) & (deepest >= 8) & (deepest < 15), _issue("info", "water.noDeepWater")),
        F.when((F.try_divide(F.col("dead"), wet) > 0.7) & (F.try_divide(wet, F.col("all")) > 0.05), _issue("warning", "water.deadZone")),
    ])


def check_starts(starts: DataFrame, world_x: float, world_z: float, players: int, place: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """``starts``: id, x, z; ``place`` is applied to the coordinates of issues.

    Pairs meet by buckets of the least spacing, so only near ones do: positions
    once, however many starts they hold, and each pair of positions is then
    repeated for all its pairs of starts.
    """
    near = 2500.0 if players <= 2 else 1400.0
    x, z = F.col("x"), F.col("z")
    off = (x < 0) | (z < 0) | (x > world_x) | (z > world_z)
    edge = F.least(x, z, F.lit(world_x) - x, F.lit(world_z) - z)
    single = _rows(starts, [
        F.when(off, _issue("error", "start.offMap", place(x), place(z))), F.when(~off & (edge < 600), _issue("warning", "start.nearEdge", place(x), place(z)))
    ])
    counts = _rows(starts.agg(F.count(F.lit(1)).alias("n")), [
        F.when(F.col("n") == 0, _issue("warning", "start.missing")), F.when((F.col("n") > 0) & (F.col("n") < players), _issue("error", "start.tooFew")),
    ])
    close = _near_positions(_positions(starts), near)
    level = F.when(F.col("d") < near * 0.6, F.lit("error")).otherwise(F.lit("warning"))
    found = close.select(level.alias("severity"), F.lit("start.tooClose").alias("code"), place((x + F.col("ox")) / 2).alias("x"), place((z + F.col("oz")) / 2).alias("z"), "times")
    return single.unionByName(counts).unionByName(_repeated(found, "times"))


def _tasks(df: DataFrame) -> int:
    """Tasks of a shuffle whose few rows stand for much work; a given number is not coalesced."""
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _positions(starts: DataFrame) -> DataFrame:
    """x, z, own (an id that occurs again, which never pairs with itself; else null), n (starts there)."""
    here = starts.where("id is not null and x is not null and z is not null").groupBy("id", "x", "z").agg(F.count(F.lit(1)).alias("n"))
    again = here.groupBy("id").agg((F.count(F.lit(1)) > 1).alias("again"), F.max("n").alias("most")).where("again or most > 1").select("id", F.col("id").alias("own"))
    return here.join(again, "id", "left").groupBy("x", "z", "own").agg(F.sum("n").alias("n"))


def _near_positions(at: DataFrame, near: float) -> DataFrame:
    """Pairs of ``at`` nearer than ``near``: x, z, ox, oz, d, times (pairs of starts with different ids).

    A bucket's rows are dealt to chunks of about ``CHUNK``, so that a crowded one is many tasks' work.
    """
    x, z = F.col("x"), F.col("z")
    cell = at.select("x", "z", "own", "n", F.floor(x / near).alias("bx"), F.floor(z / near).alias("bz"))
    chunks = cell.groupBy("bx", "bz").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
    left = cell.join(chunks, ["bx", "bz"]).withColumn("chunk", F.pmod(F.xxhash64("x", "z", "own"), F.col("chunks"))).drop("chunks")
    steps = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    right = cell.select(x.alias("ox"), z.alias("oz"), F.col("own").alias("other"), F.col("n").alias("on"), F.col("bx").alias("cx"), F.col("bz").alias("cz"))
    right = right.withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps)).select("ox", "oz", "other", "on", (F.col("cx") + F.col("i")).alias("bx"), (F.col("cz") + F.col("j")).alias("bz"))
    right = right.join(chunks, ["bx", "bz"]).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).drop("chunks")
    dx, dz, n = x - F.col("ox"), z - F.col("oz"), F.col("n")
    after = F.struct("x", "z", "own") < F.struct("ox", "oz", "other")
    same = (x == F.col("ox")) & (z == F.col("oz")) & F.col("own").eqNullSafe(F.col("other"))
    pairs = left.repartition(_tasks(at), "bx", "bz", "chunk").join(right, ["bx", "bz", "chunk"]).where(after | same)
    pairs = pairs.withColumn("d", F.sqrt(dx * dx + dz * dz)).where(F.col("d") < near)
    times = F.when(F.col("own") == F.col("other"), 0).when(same, F.expr("n * (n - 1) div 2")).otherwise(n * F.col("on"))
    return pairs.withColumn("times", times).where("times > 0").select("x", "z", "ox", "oz", "d", "times")


def _repeated(df: DataFrame, times: str) -> DataFrame:
    """Each row of ``df`` as often as its ``times`` says, in runs of ``RUN`` at most that all tasks share."""
    columns, n = [c for c in df.columns if c != times], F.col(times)
    runs = df.select(*columns, n.alias("_all"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(RUN).cast("long"))).alias("_from"))
    dealt = runs.select(*columns, F.least(F.col("_all") - F.col("_from"), F.lit(RUN)).cast("int").alias("_run")).repartition(_tasks(df))
    return dealt.select(*columns, F.explode(F.sequence(F.lit(1), F.col("_run")))).select(*columns)


def report(*checks: DataFrame) -> DataFrame:
    """All issues with the rank of their severity."""
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), F.col("severity"))
    return out.withColumn("rank", rank.cast("int"))
