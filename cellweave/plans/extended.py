"""Further registered queries: noise in SQL, snow, channels, lookups, checks, placements, erosion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.operators import channels, checks, kernels, lookups, noise, pointwise, regions, resources, rules, shapes, stencil, surface
from cellweave.operators import grid as G
from cellweave.sources import heights, png
from cellweave.sources.raw16 import scratch
from cellweave.plans.queries import (
    CELLS, CENTRES, GRAD, LAYERS, LINE, QUERIES, SLOPE_CELLS, SPOTS, SQL, STARTS, V, _box_sql, cells, graded, query, r6, raster, slope_cells, spots, step_sql, tiles,
)

# Noise: the registered queries of ``queries`` get their SQL here (octaves of lattice hashes as rows, 32-bit products in 128 bits).

WORD = 1 << 32
_OCTAVES = ", ".join(f"({o}, {4.0 * 2**o}, {0.5**o}, {(7 + o * noise.OCTAVE_SEED) * noise.SALT_SEED % WORD})" for o in range(3))
_SLOPES = " ".join(f"WHEN {i} THEN {float(a)!r} * dx + {float(b)!r} * dy" for i, (a, b) in enumerate(noise.GRADIENTS))


def _hashed(corners: str) -> str:
    return f"""WITH c AS (SELECT i % 64 AS x, i // 64 AS z FROM range(4096) r(i)), o(o, freq, amp, salt) AS (VALUES {_OCTAVES}),
p AS (SELECT x, z, o, amp, salt, x / 64.0::DOUBLE * freq + o * 17.13::DOUBLE AS u, z / 64.0::DOUBLE * freq + o * 31.77::DOUBLE AS w FROM c, o),
k AS (SELECT *, floor(u)::BIGINT AS xi, floor(w)::BIGINT AS yi, u - floor(u) AS fx, w - floor(w) AS fy FROM p),
e AS (SELECT k.*, i, j, fx - i AS dx, fy - j AS dy FROM k, (VALUES {corners}) t(i, j)),
h0 AS (SELECT *, xor(xor((((xi + i + {WORD}) % {WORD})::HUGEINT * {noise.SALT_X} % {WORD})::BIGINT, (((yi + j + {WORD}) % {WORD})::HUGEINT * {noise.SALT_Y} % {WORD})::BIGINT), salt::BIGINT) AS h FROM e),
h1 AS (SELECT * REPLACE ((xor(h, h >> 16)::HUGEINT * {noise.MIX_A} % {WORD})::BIGINT AS h) FROM h0),
h2 AS (SELECT * REPLACE ((xor(h, h >> 15)::HUGEINT * {noise.MIX_B} % {WORD})::BIGINT AS h) FROM h1),
h3 AS (SELECT * REPLACE (xor(h, h >> 15) AS h) FROM h2)"""


def _lattice(value: str, factor: float) -> str:
    fade = lambda t: f"({t} * {t} * {t} * ({t} * ({t} * 6 - 15) + 10))"
    side = lambda t, i: f"(CASE {i} WHEN 1 THEN {fade(t)} ELSE 1 - {fade(t)} END)"
    return f"""{_hashed('(0, 0), (1, 0), (0, 1), (1, 1)')},
n AS (SELECT x, z, o, any_value(amp) AS amp, sum({side('fx', 'i')} * {side('fy', 'j')} * ({value})) * {factor!r} AS n FROM h3 GROUP BY x, z, o),
t AS (SELECT x, z, max(CASE o WHEN 0 THEN n END) AS a, max(CASE o WHEN 1 THEN n END) AS b, max(CASE o WHEN 2 THEN n END) AS c FROM n GROUP BY x, z)"""


_PERLIN = _lattice(f"CASE h & 7 {_SLOPES} END", 1.4142135)
_FBM = "SELECT x, z, round((a + b * 0.5 + c * 0.25) / 1.75, 6) + 0.0 AS v FROM t"
_EDGE = lambda n: f"(1 - least(1, abs({n}) * (0.5 + 0.625 * 1.6))) ** 2"
SQL |= {
    "gen_noise_value": f"{_lattice('h / 4294967296.0::DOUBLE * 2 - 1', 1.0)} {_FBM}",
    "gen_noise_perlin": f"{_PERLIN} {_FBM}",
    "gen_noise_billow": f"{_PERLIN} SELECT x, z, round((abs(a) * 2 - 1 + (abs(b) * 2 - 1) * 0.5 + (abs(c) * 2 - 1) * 0.25) / 1.75, 6) + 0.0 AS v FROM t",
    "gen_noise_multiply": f"{_PERLIN} SELECT x, z, round(a * (0.5 + 0.5 * b) * (0.5 + 0.5 * c), 6) + 0.0 AS v FROM t",
    "gen_noise_ridged": f"""{_PERLIN}, s AS (SELECT x, z, {_EDGE('a')} AS a, {_EDGE('b')} AS b, {_EDGE('c')} AS c FROM t),
w AS (SELECT *, least(1, greatest(0, a * 2)) AS wb, least(1, greatest(0, b * 2)) AS wc FROM s) SELECT x, z, round((a + b * wb * 0.5 + c * wc * 0.25) / 1.75, 6) + 0.0 AS v FROM w""",
    "gen_noise_hybrid": f"""{_PERLIN}, s AS (SELECT x, z, (a + 1) * 0.5 AS a, (b + 1) * 0.5 AS b, (c + 1) * 0.5 AS c FROM t),
w AS (SELECT *, least(1, greatest(0.15, a * 2)) AS wb FROM s), y AS (SELECT *, least(1, greatest(0.15, wb * b * 2)) AS wc FROM w)
SELECT x, z, round((a + b * wb * 0.5 + c * wc * 0.25) / (1 + wb * 0.5 + wc * 0.25), 6) + 0.0 AS v FROM y""",
    "gen_noise_worley": f"""{_hashed(', '.join(f'({i}, {j})' for i in (-1, 0, 1) for j in (-1, 0, 1)))},
n AS (SELECT x, z, o, any_value(amp) AS amp, least(1, min(sqrt((xi + i + (h & 65535) / 65536.0::DOUBLE - u) ** 2 + (yi + j + (h >> 16) / 65536.0::DOUBLE - w) ** 2))) * 2 - 1 AS n FROM h3 GROUP BY x, z, o)
SELECT x, z, round(sum(n * amp) / sum(amp), 6) + 0.0 AS v FROM n GROUP BY x, z""",
}

# Natural and surface.

_R3 = [(w - 1) // 2 for w in stencil.gaussian_widths(3.0)]


@query("natural_snow", f""", {GRAD}, k AS (SELECT x, z, v AS h, {step_sql('(v + 20) / 60')} * least(1, greatest(0, (85 - degrees(atan(sqrt(gx * gx + gz * gz)))) / 8)) AS v FROM d),
{_box_sql('k', _R3[0], 'b1')}, {_box_sql('b1', _R3[1], 'b2')}, {_box_sql('b2', _R3[2], 'b3')}
SELECT x, z, round(k.h + greatest(k.v, b3.v * 0.5) * 8, 6) AS v, round(greatest(k.v, b3.v * 0.5), 6) AS cover FROM k JOIN b3 USING (x, z)""")
def natural_snow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(stencil.snow(raster(spark, sf_dir, 1000.0), -20.0, 85.0, 8.0, 0.5).df, v="v", cover="cover")


_FLAT = lambda limit: step_sql(f"1 - deg / {limit}")


@query("surface_channels", f""", {GRAD}, k AS (SELECT x, z, v, gx, gz, degrees(atan(sqrt(gx * gx + gz * gz))) AS deg, least(1, greatest(0, (v / 1000 / 0.02 + 1) * 0.5)) AS convex, least(1, greatest(0, v / 1000)) AS flow FROM d)
SELECT x, z, round(convex, 6) AS convex, round(CASE WHEN v <= 0 THEN 1 ELSE least(1, 0.5 * {_FLAT(28)} + 0.6 * flow) END, 6) AS wetness, round({_FLAT(25)} * (1 - convex), 6) AS deposition,
  round((1 - {_FLAT(45)}) * convex, 6) AS wear, round(0.5 + 0.5 * CASE WHEN sqrt(gx * gx + gz * gz) > 1e-9 THEN gz / sqrt(gx * gx + gz * gz) ELSE 0 END * least(1, sqrt(gx * gx + gz * gz) / 0.466), 6) AS facing FROM k""")
def surface_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = graded(spark, sf_dir).df.withColumns({"deg": stencil.slope_degrees(), "convex": channels.convexity(V() / 1000.0), "flow": pointwise.clamp01(V() / 1000.0)})
    deg, convex = F.col("deg"), F.col("convex")
    return cells(
        df, convex=convex, wetness=channels.wetness(V(), deg, F.col("flow")), deposition=channels.deposition(deg, convex), wear=channels.wear(deg, convex),
        facing=channels.facing(F.col("gx"), F.col("gz")),
    )


@query("surface_macro", f""", s AS (SELECT min(v) AS lo, max(v) AS hi FROM g) SELECT x, z, round((v - lo) / (hi - lo), 6) AS v FROM g, s""")
def surface_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(channels.spread_to_range(raster(spark, sf_dir).df, "v"), v="v")


@query("surface_flow_channel", f""", m AS (SELECT (max(x) + 1) * (max(z) + 1) * 64 * 0.0015 AS start FROM g), k AS (SELECT x, z, 1 + abs(v) * 1e7 AS n, (abs(v) * 1e7) * 56 AS area, start FROM g, m)
SELECT x, z, round(CASE WHEN area > start THEN {step_sql('(ln(greatest(area, start)) - ln(start)) / (2 * ln(10))')} ELSE 0 END, 6) AS v FROM k""")
def surface_flow_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = raster(spark, sf_dir)
    return cells(channels.flow_channel(g.with_column("flow", F.abs(V()) * 1e7 + 1)).df, v="flow")


@query("surface_shade", """, s AS (SELECT x, z, 1 - 0.85 * (1 - least(1, greatest(0, abs(v) * 3))) AS lit, least(1, greatest(0, v * 4)) AS n FROM g)
SELECT x, z, round((0.4 + 0.9 * n * lit) * 0.823486328125, 6) AS red, round((0.4 + 0.85 * n * lit) * 0.823486328125, 6) AS blue FROM s""")
def surface_shade(spark: SparkSession, sf_dir: str) -> DataFrame:
    red, _, blue = lookups.ground_shade(V() * 4.0, F.abs(V()) * 3.0)
    return cells(raster(spark, sf_dir).df, red=red, blue=blue)


@query("surface_exclusive_weights", f""", {GRAD}, s AS (SELECT x, z, v, sqrt(gx * gx + gz * gz) AS slope FROM d),
r AS (SELECT x, z, (1 - {step_sql('(v - 10) / 20')}) ** 2 AS w0, ({step_sql('(v + 40) / 80')} * (1 - {step_sql('(v - 260) / 80')}) * (1 - {step_sql('(slope - 1.25) / 0.5')})) ** 2 * 1.1 AS w1, {step_sql('(slope - 0.7) / 0.6')} ** 2 * 1.21 AS r2 FROM s)
SELECT x, z, round(w0, 6) AS w0, round(w1, 6) AS w1, round(CASE WHEN w0 + w1 > 0 THEN 0 ELSE r2 END, 6) AS w2 FROM r""")
def surface_exclusive_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dataclasses import replace

    layers = [*LAYERS[:2], replace(LAYERS[2], cap=-1.0)]
    df = graded(spark, sf_dir).df.withColumn("slope", stencil.slope())
    return cells(df, **{f"w{i}": w for i, w in enumerate(surface.weights(layers, exclusion=2.0))})


# Lookups.


def _values(rows: list[tuple]) -> str:
    return ", ".join(str(r) if len(r) > 1 else f"({r[0]!r})" for r in rows)


@query("lookup_travel", f"WITH d(id, distance, kind) AS (VALUES {_values([(i, float(d), k) for i, d, k in lookups.DISTANCES])}) SELECT id, kind, distance::DOUBLE AS distance, round(distance / 75, 6)::DOUBLE AS seconds FROM d")
def lookup_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.distances(spark).select("id", "kind", "distance", r6(lookups.travel_seconds(F.col("distance"))).alias("seconds"))


@query("lookup_sizes", f"WITH s(size_x, size_z, maps, least_players, most_players) AS (VALUES {_values(lookups.SIZES)}) SELECT size_x, size_z, maps FROM s WHERE least_players <= 10 AND most_players >= 10")
def lookup_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.recommended_sizes(spark, 10).select("size_x", "size_z", "maps")


@query("lookup_buildings", f"WITH b(id, x, z, deg) AS (VALUES {_values(rules.BUILDINGS)}) SELECT id, 2 * x AS squares_x, 2 * z AS squares_z, round(40 * tan(radians(deg)), 6) AS max_height_dif FROM b")
def lookup_buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.buildings(spark).select("id", "squares_x", "squares_z", r6("max_height_dif").alias("max_height_dif"))


@query("rules_slope_bands", f", {SLOPE_CELLS}, b AS (SELECT CASE WHEN d <= 27 THEN 'vehicle' WHEN d <= 33 THEN 'hover' WHEN d <= 54 THEN 'bot' ELSE 'allterrain' END AS band FROM (SELECT degrees(acos(1 - slope)) AS d FROM sc WHERE hi >= 0)) SELECT band, count(*)::BIGINT AS cells FROM b GROUP BY band")
def rules_slope_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.land(slope_cells(spark, sf_dir)).groupBy(rules.slope_band_of_value(F.col("slope")).alias("band")).agg(F.count(F.lit(1)).alias("cells"))


@query("rules_passable_by", f", {SLOPE_CELLS} SELECT sum((slope <= 1 - cos(radians(27)) AND -lo <= 20)::INT)::BIGINT AS tank, sum((hi < 0 OR slope <= 1 - cos(radians(33)))::INT)::BIGINT AS hover, sum((-hi >= 8)::INT)::BIGINT AS boat FROM sc")
def rules_passable_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.passable_by(slope_cells(spark, sf_dir), ("TANK3", "HOVER3", "BOAT4"))
    return rows.agg(F.sum("TANK3").alias("tank"), F.sum("HOVER3").alias("hover"), F.sum("BOAT4").alias("boat"))


# Checks.


@query("check_slopes", f""", {SLOPE_CELLS}, f AS (SELECT count(*) AS n, avg((slope <= 1 - cos(radians(27)) AND -lo <= 20)::INT) AS vehicle, avg((slope <= 1 - cos(radians(54)) AND -lo <= 20)::INT) AS bot FROM sc WHERE hi >= 0),
i AS (SELECT CASE WHEN n = 0 THEN 'warning' END AS severity, 'slope.noLand' AS code FROM f UNION ALL SELECT CASE WHEN n > 0 THEN 'info' END, 'slope.distribution' FROM f
UNION ALL SELECT CASE WHEN vehicle < 0.4 THEN 'error' WHEN vehicle < 0.6 THEN 'warning' END, 'slope.vehicleBand' FROM f UNION ALL SELECT CASE WHEN bot < 0.85 THEN 'warning' END, 'slope.botBand' FROM f)
SELECT severity, code FROM i WHERE severity IS NOT NULL""")
def check_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.check_slopes(slope_cells(spark, sf_dir)).select("severity", "code")


@query("check_size", "WITH v(severity, code) AS (VALUES ('error', 'size.dimension'), ('warning', 'size.tooSmall'), ('warning', 'size.cramped')) SELECT severity, code FROM v")
def check_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.check_size(spark.range(1), 300, 1024, 16).select("severity", "code")


@query("check_symmetry", """, o AS (SELECT max(abs(a.v - b.v)) AS d FROM hg a JOIN hg b ON b.x = 63 - a.x AND b.z = (SELECT max(z) FROM g) - a.z), s AS (SELECT max(v) - min(v) AS r FROM hg)
SELECT CASE WHEN d / r > 0.1 THEN 'error' ELSE 'warning' END AS severity, 'symmetry.height' AS code FROM o, s WHERE d / r > 0.02""")
def check_symmetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.check_symmetry(raster(spark, sf_dir, 1000.0), "rotate180").select("severity", "code")


def _starts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, x, z) for i, (x, z) in enumerate(STARTS)], "id int, px double, pz double")


@query("check_reachability")
def check_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.check_reachability(slope_cells(spark, sf_dir), 31, ("TANK3", "HOVER3"), _starts(spark)).select("class", "severity", "code", r6("x").alias("x"), r6("z").alias("z"))


@query("check_pads")
def check_pads(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = raster(spark, sf_dir, 100.0)
    fits = [rules.buildability(g, n, n, 30.0) for n in (rules.building("lab")[0], rules.building("solar")[0])]
    return checks.check_pads(*fits, _starts(spark)).select("severity", "code", "x", "z")


@query("rules_placements")
def rules_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.count_placements(rules.buildability(raster(spark, sf_dir, 100.0), 4, 4, 20.0), 4)


@query("regions_reached")
def regions_reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = raster(spark, sf_dir)
    found = regions.regions(g.df.where("v > 0.05").select("x", "z"), g.meta.width, diagonal=True)
    return regions.reached_share(found, g.meta.width * g.meta.height).select(r6("share").alias("share"))


@query("resource_density", "SELECT x, z, round(floor(least(greatest(v, 0), 1) * 255 + 0.5) * 0.9, 6) AS v FROM g")
def resource_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(raster(spark, sf_dir).df, v=resources.density(pointwise.output_terrain_type(V(), "mask")))


@query("height_range", ", s AS (SELECT min(v) AS lo, max(v) AS hi FROM hg), p AS (SELECT lo, hi, hi - lo AS span, 10 ** (floor(log10(hi - lo)) - 1) AS m FROM s), q AS (SELECT *, m * CASE WHEN span / m < 15 THEN 1 WHEN span / m < 35 THEN 2.5 WHEN span / m < 75 THEN 5 ELSE 10 END AS step FROM p) SELECT round(floor((lo - span * 0.02) / step) * step, 6) AS low, round(ceil((hi + span * 0.02) / step) * step, 6) AS high FROM q")
def height_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = pointwise.suggest_range(*raster(spark, sf_dir, 1000.0).df.agg(F.min("v"), F.max("v")).first())
    return spark.createDataFrame([(low, high)], "low double, high double").select(r6("low").alias("low"), r6("high").alias("high"))


# Simulations on a simulation grid, a map for each 64 rows.


@query("simulate_pipe")
def simulate_pipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.on_grid(tiles(spark, sf_dir), lambda a: kernels.pipe_erosion(a, 8.0, 20), ["v", "flow", "wear", "deposition", "water"])


@query("simulate_lifted")
def simulate_lifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(a):
        grid = kernels.plan_grid(a.shape[1], a.shape[0], 8.0 * a.shape[1], 4.0)
        return kernels.on_simulation_grid(a, grid, lambda s, cell: {"v": kernels.thermal(s, cell, 35.0, 4)})

    return kernels.on_grid(tiles(spark, sf_dir), run, ["v"])


# Height files.


_EXCHANGED = "SELECT z // 64 AS map_id, x, z % 64 AS z, round(floor(least(greatest((v + 1000) / 2000, 0), 1) * 65535 + 0.5) / 65535.0::DOUBLE * 2000 - 1000, 6) AS v FROM hg"


@query("io_png16", _EXCHANGED)
def io_png16(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "png16")
    png.write_png16(tiles(spark, sf_dir), path, -1000.0, 1000.0)
    return png.read_png16(spark, path, -1000.0, 1000.0).select("map_id", "x", "z", r6("v").alias("v"))


@query("io_raw_sniffed", _EXCHANGED)
def io_raw_sniffed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Big-endian samples, whose order and height the reader finds."""
    path = scratch(spark, "raw")
    heights.write_raw(tiles(spark, sf_dir), path, -1000.0, 1000.0, "big")
    return heights.read_heights(spark, path, -1000.0, 1000.0, width=64).select("map_id", "x", "z", r6("v").alias("v"))
