"""Registered queries of the raster, rule and vector operators, with DuckDB SQL beside them.

Rasters come from the tables: a row of ``embeddings`` is a row of cells, heights
are element * 1000 world units at 8 units a cell; points come from ``supplier``
and ``customer``.  Floats are rounded to 6 places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions.numeric import smoothstep
from cellweave.operators import grid as G
from cellweave.operators import checks, kernels, noise, pointwise, regions, resources, rules, shapes, stencil, surface, symmetry

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The raster in SQL: v as stored, h as height.
CELLS = (
    "g AS (SELECT vec_id AS z, generate_subscripts(embedding, 1) - 1 AS x, unnest(embedding)::DOUBLE AS v FROM embeddings), "
    "hg AS (SELECT x, z, v * 1000 AS v FROM g)"
)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql if sql.lstrip().upper().startswith("WITH") else f"WITH {CELLS} {sql}"
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raster(spark: SparkSession, sf_dir: str, scale: float = 1.0) -> G.Grid:
    return G.from_arrays(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", scale)


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def cells(df: DataFrame, **columns: Column | str) -> DataFrame:
    return df.select("x", "z", *[r6(c).alias(n) for n, c in columns.items()])


def V() -> Column:
    return F.col("v")
STEP = "(least(greatest({t}, 0), 1) ** 2 * (3 - 2 * least(greatest({t}, 0), 1)))"


def step_sql(t: str) -> str:
    return STEP.format(t=f"({t})")


# Generators.

U, W = "(i % 64) / 63.0", "(i // 64) / 63.0"


@query("gen_gradient", f"""
WITH c AS (SELECT i % 64 AS x, i // 64 AS z, {U} AS u, {W} AS w FROM range(4096) r(i)),
t AS (SELECT x, z, 1 - u AS tx, 1 - w AS tz, 1 - (u + w) * 0.5 AS td,
  1 - least(1, greatest(abs((u - 0.5) * 2), abs((w - 0.5) * 2))) AS tb,
  1 - least(1, sqrt(((u - 0.5) * 2) ** 2 + ((w - 0.5) * 2) ** 2)) AS tr FROM c)
SELECT x::BIGINT AS x, z::BIGINT AS z, round({step_sql('tx')}, 6) AS along_x, round(tz, 6) AS along_z,
  round(1 - (1 - td) ** 3, 6) AS diagonal, round({step_sql('tb')}, 6) AS box, round({step_sql('tr')}, 6) AS radial FROM t
""")
def gen_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, w = F.col("x") / 63.0, F.col("z") / 63.0
    g = G.blank(spark, G.GridMeta(64, 64)).df
    return cells(
        g, along_x=pointwise.ramp(u, w, "x"), along_z=pointwise.ramp(u, w, "z", "linear"), diagonal=pointwise.ramp(u, w, "diagonal", "sharp"),
        box=pointwise.ramp(u, w, "box"), radial=pointwise.ramp(u, w, "radial"),
    )


@query("gen_constant", "WITH c AS (SELECT 1) SELECT (i % 64)::BIGINT AS x, (i // 64)::BIGINT AS z, 2.5::DOUBLE AS v FROM range(4096) r(i)")
def gen_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(G.blank(spark, G.GridMeta(64, 64), 2.5).df, v="v")


def _noise(name: str, p: noise.Noise) -> None:
    @query(name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return cells(G.blank(spark, G.GridMeta(64, 64)).df, v=noise.fractal(F.col("x") / 64.0, F.col("z") / 64.0, p))


for _basis in ("value", "perlin", "simplex", "worley"):
    _noise(f"gen_noise_{_basis}", noise.Noise("fbm", _basis, 4.0, 3, seed=7))
for _fractal in ("ridged", "billow", "hybrid", "multiply"):
    _noise(f"gen_noise_{_fractal}", noise.Noise(_fractal, "perlin", 4.0, 3, seed=7))


@query("gen_noise_warped")
def gen_noise_warped(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = noise.Noise(octaves=2, frequency=4.0, seed=3)
    by = [noise.Noise(octaves=1, frequency=2.0, seed=s) for s in (11, 12)]
    return cells(G.blank(spark, G.GridMeta(64, 64)).df, v=noise.warped(F.col("x") / 64.0, F.col("z") / 64.0, base, *by, 0.1))


# Cell operators.

PAIR = "p AS (SELECT g.x, g.z, g.v AS a, o.v AS b FROM g JOIN g o ON o.z = g.z AND o.x = 63 - g.x)"


def pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two aligned rasters: the second is the first mirrored along x."""
    one = raster(spark, sf_dir)
    other = G.Grid(one.df.withColumn("x", F.lit(one.meta.width - 1) - F.col("x")), one.meta)
    return one.zip(other, "b").df.withColumnRenamed("v", "a")


@query("combine_modes", f"""
WITH {CELLS}, {PAIR}
SELECT x, z, round(a + b, 6) AS add, round(a - b, 6) AS subtract, round(a * b, 6) AS multiply, round(CASE WHEN b = 0 THEN 0 ELSE a / b END, 6) AS divide,
  round(greatest(a, b), 6) AS max, round(least(a, b), 6) AS min, round(abs(a - b), 6) AS difference, round((a + b) / 2, 6) AS average,
  round(1 - (1 - a) * (1 - b), 6) AS screen, round(CASE WHEN a < 0.5 THEN 2 * a * b ELSE 1 - 2 * (1 - a) * (1 - b) END, 6) AS overlay FROM p
""")
def combine_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(pair(spark, sf_dir), **{m: pointwise.combine(F.col("a"), F.col("b"), m) for m in pointwise.BLENDS})


@query("blend_split", f"""
WITH {CELLS}, {PAIR}, m AS (SELECT *, {step_sql('(a + 0.05) / 0.1')} AS m FROM p)
SELECT x, z, round(a + (b - a) * 0.3, 6) AS blend, round(a + (b - a) * m, 6) AS split, round(m, 6) AS mask FROM m
""")
def blend_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    split, mask = pointwise.height_split(a, b, 0.0, 0.1)
    return cells(pair(spark, sf_dir), blend=pointwise.masked(a, b, 0.3), split=split, mask=mask)


@query("filter_remap_terrace", """, m AS (SELECT min(v) lo, max(v) hi FROM g), t AS (SELECT x, z, v, lo, hi, (v - lo) / (hi - lo) * 6 AS s FROM g, m)
SELECT x, z, round(-1 + (v - lo) * (3 / (hi - lo)), 6) AS remapped,
  round(lo + (floor(s) + (s - floor(s)) * 0.5 + (s - floor(s)) ** (1 / (1 - 0.5 * 0.999)) * 0.5) / 6 * (hi - lo), 6) AS terraced FROM t""")
def filter_remap_terrace(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pointwise.ranged(raster(spark, sf_dir).df)
    lo, hi = F.col("lo"), F.col("hi")
    return cells(rows, remapped=pointwise.remap(V(), lo, hi, -1, 2), terraced=pointwise.terrace(V(), 6, 0.5, lo, hi))


@query("filter_curve", """, m AS (SELECT min(v) lo, max(v) hi FROM g), t AS (SELECT x, z, lo, hi, (v - lo) / (hi - lo) AS t FROM g, m),
k AS (SELECT *, CASE WHEN t <= 0.5 THEN t / 0.5 ELSE (t - 0.5) / 0.5 END AS q FROM t)
SELECT x, z, round(lo + (CASE WHEN t <= 0 THEN 0 WHEN t >= 1 THEN 1
  WHEN t <= 0.5 THEN (q**3 - 2*q**2 + q) * 0.5 * 0.4 + (3*q**2 - 2*q**3) * 0.2 + (q**3 - q**2) * 0.5 * (2 * 0.4 * 1.6 / 2.0)
  ELSE (2*q**3 - 3*q**2 + 1) * 0.2 + (q**3 - 2*q**2 + q) * 0.5 * (2 * 0.4 * 1.6 / 2.0) + (3*q**2 - 2*q**3) * 1 + (q**3 - q**2) * 0.5 * 1.6 END) * (hi - lo), 6) AS v FROM k""")
def filter_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pointwise.ranged(raster(spark, sf_dir).df)
    return cells(rows, v=pointwise.apply_curve(V(), [(0, 0), (0.5, 0.2), (1, 1)], F.col("lo"), F.col("hi")))


@query("filter_clamp", """SELECT x, z, round(least(greatest(v, -0.1), 0.1), 6) AS hard,
  round(CASE WHEN v < -0.05 THEN -0.1 + 0.05 * (CASE WHEN (v + 0.1) / 0.05 >= 1 THEN (v + 0.1) / 0.05 ELSE exp((v + 0.1) / 0.05 - 1) END)
    WHEN v > 0.05 THEN 0.1 - 0.05 * (CASE WHEN (0.1 - v) / 0.05 >= 1 THEN (0.1 - v) / 0.05 ELSE exp((0.1 - v) / 0.05 - 1) END) ELSE v END, 6) AS soft FROM g""")
def filter_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(raster(spark, sf_dir).df, hard=pointwise.clamp_soft(V(), -0.1, 0.1, 0), soft=pointwise.clamp_soft(V(), -0.1, 0.1, 0.05))


@query("field_arithmetic", f"""SELECT x, z, round(v + 2, 6) AS added, round(v * 3, 6) AS scaled, round(1 - v, 6) AS inverted,
  round({step_sql('(v + 0.2) / 0.4')}, 6) AS stepped FROM g""")
def field_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(raster(spark, sf_dir).df, added=V() + 2, scaled=V() * 3, inverted=F.lit(1.0) - V(), stepped=smoothstep(V(), -0.2, 0.2))


@query("field_normalise", ", m AS (SELECT min(v) lo, max(v) hi FROM g) SELECT x, z, round((v - lo) / (hi - lo), 6) AS v FROM g, m")
def field_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(pointwise.ranged(raster(spark, sf_dir).df), v=pointwise.remap(V(), F.col("lo"), F.col("hi"), 0, 1))


@query("utility_math", """SELECT x, z, round(v * 2, 6) AS multiply, round(v + 2, 6) AS add, round(sign(v) * abs(v) ** 2, 6) AS power, round(abs(v), 6) AS abs,
  round(-v, 6) AS negate, round(1 - v, 6) AS oneMinus, round(floor(v / 2) * 2, 6) AS floor, (CASE WHEN v >= 2 THEN 1 ELSE 0 END)::DOUBLE AS step FROM g""")
def utility_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("multiply", "add", "power", "abs", "negate", "oneMinus", "floor", "step")
    return cells(raster(spark, sf_dir).df, **{n: pointwise.math(V(), n, 2.0) for n in names})


@query("utility_statistics", "SELECT round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean, round(max(v) - min(v), 6) AS range FROM g")
def utility_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pointwise.statistics(raster(spark, sf_dir).df).select(*[r6(c).alias(c) for c in ("min", "max", "mean", "range")])


@query("filter_sea_level", """, o AS (SELECT v, row_number() OVER (ORDER BY v) AS r, count(*) OVER () AS n FROM g),
s AS (SELECT v AS s FROM o WHERE r = floor(0.2 * (n - 1) + 0.5) + 1)
SELECT x, z, round(v - s, 6) AS v, (CASE WHEN v - s >= 0 THEN 1 ELSE 0 END)::DOUBLE AS land FROM g, s""")
def filter_sea_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(pointwise.sea_level(raster(spark, sf_dir).df, 0.2), v="v", land="land")


@query("filter_flatten", ", m AS (SELECT avg(v) a, min(v) lo FROM g) SELECT x, z, round(v + (a - v) * 0.5, 6) AS average, round(v + (lo - v) * 0.25, 6) AS lowest FROM g, m")
def filter_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = raster(spark, sf_dir).df
    low = pointwise.flatten(df, "lowest", 0.25).withColumnRenamed("v", "lowest")
    return cells(pointwise.flatten(df, "average", 0.5).withColumnRenamed("v", "average").join(low, ["x", "z"]), average="average", lowest="lowest")


@query("selector_height", f"""SELECT x, z, round({step_sql('CASE WHEN v < -0.05 THEN (v + 0.1) / 0.05 WHEN v > 0.1 THEN (0.15 - v) / 0.05 ELSE 1 END')}, 6) AS mask FROM g""")
def selector_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(raster(spark, sf_dir).df, mask=pointwise.band_mask(V(), -0.05, 0.1, 0.05))


@query("output_layers", """, c AS (SELECT x, z, v, ((v * 1.2) - 0.5) * 1.1 + 0.5 AS r, ((v * v * 1.2) - 0.5) * 1.1 + 0.5 AS gr, ((abs(v) * 1.2) - 0.5) * 1.1 + 0.5 AS b FROM g),
l AS (SELECT *, r * 0.2126 + gr * 0.7152 + b * 0.0722 AS luma FROM c)
SELECT x, z, round(least(greatest(luma + (r - luma) * 0.8, 0), 1), 6) AS red, round(least(greatest(luma + (gr - luma) * 0.8, 0), 1), 6) AS green,
  round(least(greatest(luma + (b - luma) * 0.8, 0), 1), 6) AS blue, round(CASE WHEN v * 2 < 0.1 THEN 0 ELSE least(greatest(v * 2, 0), 1) END, 6) AS metal,
  floor(least(greatest(v, 0), 1) * 255 + 0.5)::DOUBLE AS kind FROM l""")
def output_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    red, green, blue = pointwise.output_texture(V(), V() * V(), F.abs(V()), 1.2, 1.1, 0.8)
    return cells(
        raster(spark, sf_dir).df, red=red, green=green, blue=blue, metal=pointwise.output_metal(V(), 2.0, 0.1), kind=pointwise.output_terrain_type(V(), "mask").cast("double"),
    )


@query("height_quantise", "SELECT x, z, least(greatest(floor((v + 600) / 1200 * 65536 + 0.5), 0), 65535)::DOUBLE AS raw, round(-600 + least(greatest(floor((v + 600) / 1200 * 65536 + 0.5), 0), 65535) / 65536.0 * 1200, 6) AS back FROM hg")
def height_quantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = pointwise.quantise(V(), -600, 600)
    return cells(raster(spark, sf_dir, 1000.0).df, raw=raw.cast("double"), back=pointwise.dequantise(raw, -600, 600))


@query("srgb_codec", """, c AS (SELECT x, z, least(1, greatest(0, v * 4)) AS v FROM g) SELECT x, z, round(CASE WHEN v <= 0.04045 THEN v / 12.92 ELSE ((v + 0.055) / 1.055) ** 2.4 END, 6) AS linear,
  round(CASE WHEN v <= 0.0031308 THEN v * 12.92 ELSE 1.055 * v ** (1 / 2.4) - 0.055 END, 6) AS encoded FROM c""")
def srgb_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(raster(spark, sf_dir).df, linear=pointwise.srgb_to_linear(V() * 4.0), encoded=pointwise.linear_to_srgb(V() * 4.0))


# Stencils.

GRAD = """n AS (SELECT x, z, v, coalesce(lead(v) OVER wx, v) AS e, coalesce(lag(v) OVER wx, v) AS w, coalesce(lead(v) OVER wz, v) AS s, coalesce(lag(v) OVER wz, v) AS n
  FROM hg WINDOW wx AS (PARTITION BY z ORDER BY x), wz AS (PARTITION BY x ORDER BY z)),
d AS (SELECT *, (e - w) / 16 AS gx, (s - n) / 16 AS gz FROM n)"""


def graded(spark: SparkSession, sf_dir: str) -> G.Grid:
    return stencil.gradient(raster(spark, sf_dir, 1000.0))


@query("analysis_slope", f", {GRAD} SELECT x, z, round(sqrt(gx * gx + gz * gz), 6) AS slope, round(degrees(atan(sqrt(gx * gx + gz * gz))), 6) AS deg, round(atan2(gz, gx), 6) AS aspect FROM d")
def analysis_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(graded(spark, sf_dir).df, slope=stencil.slope(), deg=stencil.slope_degrees(), aspect=stencil.aspect())


@query("selector_slope", f", {GRAD}, a AS (SELECT x, z, degrees(atan(sqrt(gx * gx + gz * gz))) AS v FROM d) SELECT x, z, round({step_sql('CASE WHEN v > 60 THEN (70 - v) / 10 ELSE 1 END')}, 6) AS mask FROM a")
def selector_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(graded(spark, sf_dir).df, mask=pointwise.band_mask(stencil.slope_degrees(), 0, 60, 10))


@query("analysis_hillshade", f""", {GRAD} SELECT x, z,
  round(greatest(0, (-gx * sin(radians(315)) * cos(radians(45)) + sin(radians(45)) - gz * -cos(radians(315)) * cos(radians(45))) / sqrt(gx * gx + 1 + gz * gz)), 6) AS light,
  round(-gx / sqrt(gx * gx + gz * gz + 1) * 0.5 + 0.5, 6) AS nx, round(-gz / sqrt(gx * gx + gz * gz + 1) * 0.5 + 0.5, 6) AS nz, round(1 / sqrt(gx * gx + gz * gz + 1) * 0.5 + 0.5, 6) AS ny FROM d""")
def analysis_hillshade(spark: SparkSession, sf_dir: str) -> DataFrame:
    nx, nz, ny = stencil.normal_map()
    return cells(graded(spark, sf_dir).df, light=stencil.hillshade(315, 45), nx=nx, nz=nz, ny=ny)


@query("analysis_curvature", """, a AS (SELECT x, z, v, coalesce(lead(v) OVER wx, v) AS e, coalesce(lag(v) OVER wx, v) AS w FROM hg WINDOW wx AS (PARTITION BY z ORDER BY x)),
b AS (SELECT *, coalesce(lead(v) OVER wz, v) AS s, coalesce(lag(v) OVER wz, v) AS n, coalesce(lead(e) OVER wz, e) AS se, coalesce(lag(e) OVER wz, e) AS ne,
  coalesce(lead(w) OVER wz, w) AS sw, coalesce(lag(w) OVER wz, w) AS nw FROM a WINDOW wz AS (PARTITION BY x ORDER BY z)),
c AS (SELECT x, z, (e - w) / 16 AS zx, (s - n) / 16 AS zy, (e - 2 * v + w) / 64 AS zxx, (s - 2 * v + n) / 64 AS zyy, (se - ne - sw + nw) / 256 AS zxy FROM b),
q AS (SELECT *, zx * zx + zy * zy AS p, 1 + zx * zx + zy * zy AS q FROM c)
SELECT x, z, round(((1 + zy * zy) * zxx - 2 * zx * zy * zxy + (1 + zx * zx) * zyy) / (2 * q ** 1.5), 6) AS mean, round((zxx * zyy - zxy * zxy) / (q * q), 6) AS gaussian,
  round(CASE WHEN p = 0 THEN 0 ELSE -(zy * zy * zxx - 2 * zx * zy * zxy + zx * zx * zyy) / p ** 1.5 END, 6) AS planform,
  round(CASE WHEN p = 0 THEN 0 ELSE -(zx * zx * zxx + 2 * zx * zy * zxy + zy * zy * zyy) / (p * q ** 1.5) END, 6) AS profile FROM q""")
def analysis_curvature(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("mean", "gaussian", "planform", "profile")
    return cells(stencil.curvature(raster(spark, sf_dir, 1000.0)).df, **{n: n for n in names})


def _box_sql(source: str, r: int, out: str) -> str:
    n = 2 * r + 1
    return f"""{out}x AS (SELECT x, z, (sum(v) OVER (w ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING) + first_value(v) OVER f * greatest(0, {r} - x)
  + last_value(v) OVER f * greatest(0, x + {r} - 63)) / {n} AS v FROM {source} WINDOW w AS (PARTITION BY z ORDER BY x), f AS (PARTITION BY z ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
{out} AS (SELECT x, z, (sum(v) OVER (w ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING) + first_value(v) OVER f * greatest(0, {r} - z)
  + last_value(v) OVER f * greatest(0, z + {r} - (SELECT max(z) FROM g))) / {n} AS v FROM {out}x WINDOW w AS (PARTITION BY x ORDER BY z), f AS (PARTITION BY x ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


@query("filter_box_blur", f", {_box_sql('g', 3, 'b1')} SELECT x, z, round(v, 6) AS v FROM b1")
def filter_box_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(stencil.box_blur(raster(spark, sf_dir), 3).df, v="v")


_R = [(w - 1) // 2 for w in stencil.gaussian_widths(2.0)]


@query("filter_smooth", f", {_box_sql('g', _R[0], 'b1')}, {_box_sql('b1', _R[1], 'b2')}, {_box_sql('b2', _R[2], 'b3')} SELECT x, z, round(b3.v, 6) AS smooth, round(g.v + (g.v - b3.v) * 0.5, 6) AS sharp FROM b3 JOIN g USING (x, z)")
def filter_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    blurred = stencil.gaussian_blur(raster(spark, sf_dir).with_column("b", V()), 2.0, "b").df
    return cells(blurred, smooth="b", sharp=V() + (V() - F.col("b")) * 0.5)


@query("surface_dilate", """, a AS (SELECT x, z, max(v) OVER (PARTITION BY z ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM g)
SELECT x, z, round(max(v) OVER (PARTITION BY x ORDER BY z ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS v FROM a""")
def surface_dilate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(stencil.dilate(raster(spark, sf_dir), 2).df, v="v")


@query("rules_window_extrema", """, a AS (SELECT x, z, min(v) OVER w AS lo, max(v) OVER w AS hi FROM g WINDOW w AS (PARTITION BY z ORDER BY x ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
b AS (SELECT x, z, min(lo) OVER w AS lo, max(hi) OVER w AS hi FROM a WHERE x <= 60 WINDOW w AS (PARTITION BY x ORDER BY z ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))
SELECT x, z, round(lo, 6) AS lo, round(hi, 6) AS hi FROM b WHERE z <= (SELECT max(z) FROM g) - 3""")
def rules_window_extrema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(stencil.window_extrema(raster(spark, sf_dir), 4, 4), lo="lo", hi="hi")


CENTRES = """c AS (SELECT a.x, a.z, (a.v + b.v + c.v + d.v) / 4 AS v FROM hg a JOIN hg b ON b.x = a.x + 1 AND b.z = a.z JOIN hg c ON c.x = a.x AND c.z = a.z + 1 JOIN hg d ON d.x = a.x + 1 AND d.z = a.z + 1)"""


@query("rules_square_centres", f", {CENTRES} SELECT x, z, round(v, 6) AS v FROM c")
def rules_square_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(stencil.square_centres(raster(spark, sf_dir, 1000.0)).df, v="v")


@query("image_half", "SELECT (x // 2)::BIGINT AS x, (z // 2)::BIGINT AS z, round(avg(v), 6) AS v FROM g GROUP BY ALL")
def image_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(stencil.downsample_half(raster(spark, sf_dir).df), v="v")


@query("field_resample", """, s AS (SELECT max(z) + 1 AS h FROM g), tx AS (SELECT i AS t, floor(i * 64 / 24.0) AS a, greatest(floor(i * 64 / 24.0) + 1, ceil((i + 1) * 64 / 24.0)) AS b FROM range(24) r(i)),
tz AS (SELECT i AS t, floor(i * h / 100.0) AS a, greatest(floor(i * h / 100.0) + 1, ceil((i + 1) * h / 100.0)) AS b FROM range(100) r(i), s)
SELECT tx.t AS x, tz.t AS z, round(avg(v), 6) AS v FROM g JOIN tx ON x >= tx.a AND x < tx.b JOIN tz ON z >= tz.a AND z < tz.b GROUP BY ALL""")
def field_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(stencil.resample_shrink(raster(spark, sf_dir), 24, 100).df, v="v")


SAMPLE = """k AS (SELECT *, floor(sx) AS i, floor(sz) AS j, sx - floor(sx) AS fx, sz - floor(sz) AS fz, (SELECT max(z) FROM g) AS mz FROM pts)
SELECT k.x, k.z, round(a.v * (1 - fx) * (1 - fz) + b.v * fx * (1 - fz) + c.v * (1 - fx) * fz + d.v * fx * fz, 6) AS v FROM k
JOIN g a ON a.x = least(greatest(i, 0), 63) AND a.z = least(greatest(j, 0), mz) JOIN g b ON b.x = least(greatest(i + 1, 0), 63) AND b.z = least(greatest(j, 0), mz)
JOIN g c ON c.x = least(greatest(i, 0), 63) AND c.z = least(greatest(j + 1, 0), mz) JOIN g d ON d.x = least(greatest(i + 1, 0), 63) AND d.z = least(greatest(j + 1, 0), mz)"""


@query("filter_transform", f""", s AS (SELECT (max(z) + 1) / 2.0 AS cz FROM g), pts AS (SELECT x, z, 32 + (x - 32) / 1.5 * cos(0.3) - (z - cz) / 1.5 * sin(0.3) + 2.5 AS sx,
  cz + (x - 32) / 1.5 * sin(0.3) + (z - cz) / 1.5 * cos(0.3) - 1.25 AS sz FROM g, s), {SAMPLE}""")
def filter_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(stencil.transform(raster(spark, sf_dir), 2.5, -1.25, 1.5, 0.3), v="v")


@query("filter_warp", f""", pts AS (SELECT x, z, x + (coalesce(lead(v) OVER wx, v) - coalesce(lag(v) OVER wx, v)) * 0.5 * 4 AS sx, z + (coalesce(lead(v) OVER wz, v) - coalesce(lag(v) OVER wz, v)) * 0.5 * 4 AS sz
  FROM g WINDOW wx AS (PARTITION BY z ORDER BY x), wz AS (PARTITION BY x ORDER BY z)), {SAMPLE}""")
def filter_warp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(stencil.warp(raster(spark, sf_dir), "v", 4.0), v="v")


# Rules.

SLOPE_CELLS = """q AS (SELECT a.x, a.z, 8 / sqrt((b.v - a.v) ** 2 + 64 + (c.v - a.v) ** 2) AS n1, 8 / sqrt((c.v - d.v) ** 2 + 64 + (b.v - d.v) ** 2) AS n2, least(a.v, b.v, c.v, d.v) AS lo, greatest(a.v, b.v, c.v, d.v) AS hi
  FROM hg a JOIN hg b ON b.x = a.x + 1 AND b.z = a.z JOIN hg c ON c.x = a.x AND c.z = a.z + 1 JOIN hg d ON d.x = a.x + 1 AND d.z = a.z + 1),
s AS (SELECT x // 2 AS cx, z // 2 AS cz, sum(n1 + n2) / 8 AS av, min(least(n1, n2)) AS mn, min(lo) AS lo, max(hi) AS hi FROM q GROUP BY ALL HAVING count(*) = 4),
sc AS (SELECT cx, cz, 1 - (mn + (av - mn) * mn / av) AS slope, lo, hi FROM s)"""


def slope_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.slope_cells(raster(spark, sf_dir, 1000.0))


@query("rules_engine_slope", f", {SLOPE_CELLS} SELECT cx, cz, round(slope, 6) AS slope, round(lo, 6) AS lo, round(hi, 6) AS hi FROM sc")
def rules_engine_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slope_cells(spark, sf_dir).select("cx", "cz", *[r6(c).alias(c) for c in ("slope", "lo", "hi")])


_CLASSES = ", ".join(f"('{i}', '{fam}', {deg}, {lo}, {hi})" for i, fam, _, deg, _, lo, hi, _ in rules.MOVE_CLASSES)


@query("rules_passability", f""", {SLOPE_CELLS}, m(id, family, deg, lod, hid) AS (VALUES {_CLASSES}),
p AS (SELECT id, CASE WHEN family = 'ship' THEN -hi >= lod WHEN family = 'hover' THEN hi < 0 OR deg >= 90 OR slope <= 1 - cos(radians(deg))
  ELSE (deg >= 90 OR slope <= 1 - cos(radians(deg))) AND -lo <= hid END AS ok FROM sc, m)
SELECT id, count(*)::BIGINT AS cells, sum(ok::INT)::BIGINT AS passable FROM p GROUP BY id""")
def rules_passability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.passability(slope_cells(spark, sf_dir)).groupBy("id").agg(F.count(F.lit(1)).alias("cells"), F.sum("passable").alias("passable"))


@query("slope_band_share", f""", {GRAD}, b AS (SELECT CASE WHEN deg <= 27 THEN 'vehicle' WHEN deg <= 33 THEN 'hover' WHEN deg <= 54 THEN 'bot' ELSE 'allterrain' END AS band
  FROM (SELECT degrees(atan(sqrt(gx * gx + gz * gz))) AS deg, v FROM d) WHERE v >= 0)
SELECT band, count(*)::BIGINT AS cells, round(count(*) / (SELECT count(*) FROM b), 6) AS share FROM b GROUP BY band""")
def slope_band_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What share of the land is in each slope band?"""
    land = graded(spark, sf_dir).df.where("v >= 0").select(rules.slope_band(stencil.slope_degrees()).alias("band"))
    counts = land.groupBy("band").agg(F.count(F.lit(1)).alias("cells"))
    total = counts.agg(F.sum("cells").alias("all"))
    return counts.join(F.broadcast(total)).select("band", "cells", r6(F.col("cells") / F.col("all")).alias("share"))


@query("rules_buildability", f""", {CENTRES}, a AS (SELECT x, z, min(v) OVER w AS lo, max(v) OVER w AS hi, lead(v, 2) OVER (PARTITION BY z ORDER BY x) AS p FROM c WINDOW w AS (PARTITION BY z ORDER BY x ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
b AS (SELECT x, z, min(lo) OVER w AS lo, max(hi) OVER w AS hi, lead(p, 2) OVER (PARTITION BY x ORDER BY z) AS p FROM a WINDOW w AS (PARTITION BY x ORDER BY z ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))
SELECT x, z, (hi - p <= 150 AND p - lo <= 150)::INT AS fits FROM b WHERE x <= 63 - 4 AND z <= (SELECT max(z) FROM c) - 3""")
def rules_buildability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.buildability(raster(spark, sf_dir, 1000.0), 4, 4, 150.0)


@query("rules_largest_footprint")
def rules_largest_footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.largest_footprint(raster(spark, sf_dir, 1000.0), 200.0, 3)


@query("rules_terrain_type", f", {GRAD} SELECT x, z, CASE WHEN v < 0 THEN 3 WHEN degrees(atan(sqrt(gx * gx + gz * gz))) > 27 THEN 1 WHEN v < 12 THEN 2 ELSE 0 END AS kind FROM d")
def rules_terrain_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graded(spark, sf_dir).df.select("x", "z", rules.terrain_type(V(), stencil.slope_degrees()).alias("kind"))


SPOTS = "sp AS (SELECT s_suppkey AS id, (s_suppkey * 37 % 512)::DOUBLE * 2 AS px, (s_suppkey * 91 % 4096)::DOUBLE * 2 AS pz, s_acctbal AS worth FROM supplier)"


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey").cast("long")
    return read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), ((k * 37 % 512).cast("double") * 2).alias("px"), ((k * 91 % 4096).cast("double") * 2).alias("pz"), F.col("s_acctbal").alias("worth")
    )


@query("rules_income", f"""
WITH {CELLS}, {SPOTS}, m AS (SELECT x, z, floor(least(greatest(v, 0), 1) * 255 + 0.5)::BIGINT AS b FROM g)
SELECT id, round((coalesce(sum(b), 0) * 0.9 * 0.001)::DOUBLE, 6) AS income FROM sp LEFT JOIN m ON ((x + 0.5) * 16 - px) ** 2 + ((z + 0.5) * 16 - pz) ** 2 < 8100 GROUP BY id""")
def rules_income(spark: SparkSession, sf_dir: str) -> DataFrame:
    metal = raster(spark, sf_dir).df.select("x", "z", pointwise.output_terrain_type(V(), "mask").cast("long").alias("b"))
    return rules.income(metal, spots(spark, sf_dir)).select("id", r6("income").alias("income"))


STARTS = [(128.0, 512.0), (900.0, 4000.0), (512.0, 7600.0)]


@query("rules_balance", f"""
WITH {SPOTS}, st(player, sx, sz) AS (VALUES (0, 128, 512), (1, 900, 4000), (2, 512, 7600)),
d AS (SELECT id, worth, player, sqrt((px - sx) ** 2 + (pz - sz) ** 2) AS d FROM sp, st),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, player) AS r, min(d) OVER (PARTITION BY id) AS d1, nth_value(d, 2) OVER (PARTITION BY id ORDER BY d, player ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS d2 FROM d),
c AS (SELECT *, r = 1 AND NOT ((CASE WHEN d2 > 0 THEN (d2 - d1) / d2 ELSE 0 END) < 0.15) AS mine FROM r)
SELECT player, count(*) FILTER (mine)::BIGINT AS spots, round(coalesce(sum(worth) FILTER (mine), 0), 6) AS income, round(coalesce(sum(worth) FILTER (mine AND d1 <= 1200), 0), 6) AS base_income, round(min(d), 6) AS nearest FROM c GROUP BY player""")
def rules_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = spots(spark, sf_dir).select(F.col("px").alias("x"), F.col("pz").alias("z"), F.col("worth").alias("income"))
    return rules.balance(at, STARTS).select("player", "spots", *[r6(c).alias(c) for c in ("income", "base_income", "nearest")])


@query("rules_start_boxes", f"""
WITH {SPOTS}, t AS (SELECT id % 4 AS team, min(px) AS x0, max(px) AS x1, min(pz) AS z0, max(pz) AS z1 FROM sp GROUP BY 1)
SELECT team, least(200, greatest(0, floor((x0 - 163.84) / 1024 * 200 + 0.5)))::BIGINT AS "left", least(200, greatest(0, floor((z0 - 900) / 8192 * 200 + 0.5)))::BIGINT AS top,
  least(200, greatest(0, floor((x1 + 163.84) / 1024 * 200 + 0.5)))::BIGINT AS "right", least(200, greatest(0, floor((z1 + 900) / 8192 * 200 + 0.5)))::BIGINT AS bottom FROM t""")
def rules_start_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = spots(spark, sf_dir).select((F.col("id") % 4).alias("team"), F.col("px").alias("x"), F.col("pz").alias("z"))
    return rules.start_boxes(at, 1024.0, 8192.0)


@query("rules_move_classes", f"""
WITH m(id, family, deg, lod, hid) AS (VALUES {_CLASSES})
SELECT id, family, round(1 - cos(radians(deg)), 6) AS max_slope_value, (family = 'ship' OR deg >= 90) AS ignores_slope, (family = 'hover') AS ignores_depth FROM m""")
def rules_move_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.move_classes(spark).select("id", "family", r6("max_slope_value").alias("max_slope_value"), "ignores_slope", "ignores_depth")


# Checks and resources.


@query("check_heights", """, s AS (SELECT min(v) AS lo, max(v) AS hi FROM hg), i AS (
SELECT CASE WHEN -100 - lo > 200 / 65536.0 OR hi - 100 > 200 / 65536.0 THEN 'error' END AS severity, 'height.clipped' AS code FROM s
UNION ALL SELECT CASE WHEN (hi - lo) / 200 < 0.2 THEN CASE WHEN degrees(atan(200 / 65536.0 / 8)) >= 0.25 THEN 'warning' ELSE 'info' END END, 'height.rangeWaste' FROM s
UNION ALL SELECT CASE WHEN hi - lo < 100 THEN 'info' END, 'height.flat' FROM s
UNION ALL SELECT CASE WHEN max(-v) < 8 THEN 'warning' END, 'water.tooShallow' FROM hg HAVING count(*) FILTER (v < 0) > 0
UNION ALL SELECT CASE WHEN max(-v) >= 8 AND max(-v) < 15 THEN 'info' END, 'water.noDeepWater' FROM hg
UNION ALL SELECT CASE WHEN count(*) FILTER (v >= 0) = count(*) THEN 'info' END, 'water.none' FROM hg
UNION ALL SELECT CASE WHEN count(*) FILTER (v <= -1 AND v > -8) > 0.7 * count(*) FILTER (v < 0) AND count(*) FILTER (v < 0) > 0.05 * count(*) THEN 'warning' END, 'water.deadZone' FROM hg)
SELECT severity, code FROM i WHERE severity IS NOT NULL""")
def check_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = raster(spark, sf_dir, 1000.0).df
    return checks.report(checks.check_heights(h, -100.0, 100.0), checks.check_water(h)).select("severity", "code")


@query("check_starts", f"""
WITH {SPOTS}, i AS (SELECT CASE WHEN px > 1024 OR pz > 8192 THEN 'error' ELSE 'warning' END AS severity, CASE WHEN px > 1024 OR pz > 8192 THEN 'start.offMap' ELSE 'start.nearEdge' END AS code, px AS x, pz AS z FROM sp
  WHERE px > 1024 OR pz > 8192 OR least(px, pz, 1024 - px, 8192 - pz) < 600
UNION ALL SELECT CASE WHEN sqrt((a.px - b.px) ** 2 + (a.pz - b.pz) ** 2) < 840 THEN 'error' ELSE 'warning' END, 'start.tooClose', (a.px + b.px) / 2, (a.pz + b.pz) / 2 FROM sp a JOIN sp b ON a.id < b.id
  WHERE sqrt((a.px - b.px) ** 2 + (a.pz - b.pz) ** 2) < 1400)
SELECT severity, code, round(x, 6) AS x, round(z, 6) AS z FROM i""")
def check_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = spots(spark, sf_dir).select("id", F.col("px").alias("x"), F.col("pz").alias("z"))
    return checks.check_starts(at, 1024.0, 8192.0, 8, r6)


@query("resource_paint")
def resource_paint(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = spots(spark, sf_dir).select("id", F.floor(F.col("px") / 16).alias("cx"), F.floor(F.col("pz") / 16).alias("cz"), (F.abs("worth") / 5000).alias("income"))
    return resources.paint(at, 64, 512)


@query("resource_find")
def resource_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = raster(spark, sf_dir)
    metal = g.df.select("x", "z", pointwise.output_terrain_type(F.col("v") - 0.1, "mask").cast("int").alias("b"))
    return resources.find_spots(metal, g.meta.width, g.meta.height)


@query("tiles_distinct", "SELECT doc_id AS pos, min(doc_id) OVER (PARTITION BY text) AS first FROM documents")
def tiles_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tile deduplication by digest; the texts of ``documents`` stand for tile bytes."""
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.col("text").cast("binary").alias("data"))
    return resources.distinct_tiles(rows)


SITES = [(16.0, 16.0, 12.0, 200.0), (40.0, 30.0, 20.0, -90.0), (50.0, 50.0, 9.0, 140.0)]


@query("gen_plateaus", f"""
WITH c AS (SELECT (i % 64)::BIGINT AS x, (i // 64)::BIGINT AS z FROM range(4096) r(i)), s(n, cx, cz, r, h) AS (VALUES (0, 16, 16, 12, 200), (1, 40, 30, 20, -90), (2, 50, 50, 9, 140)),
e AS (SELECT x, z, n, h, greatest(0, 1 - sqrt(((x - cx) / r::DOUBLE) ** 2 + ((z - cz) / r::DOUBLE) ** 2)) AS e FROM c, s), w AS (SELECT *, e * e * (3 - 2 * e) AS w FROM e)
SELECT x, z, round(arg_max(h * w, abs(h * w)) + 0.0, 6) AS v, round(max(w), 6) AS mask FROM w GROUP BY x, z""")
def gen_plateaus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(resources.plateaus(spark, G.GridMeta(64, 64), SITES).df, v="v", mask="mask")


# Regions.


@query("regions_islands")
def regions_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = raster(spark, sf_dir)
    return regions.regions(g.df.where("v > 0.05").select("x", "z"), g.meta.width, diagonal=True)


@query("regions_runs", ", i AS (SELECT x, z, x - row_number() OVER (PARTITION BY z ORDER BY x) AS k FROM g WHERE v > 0.05) SELECT z, min(x) AS x0, max(x) AS x1, z * 64 + min(x) AS run FROM i GROUP BY z, k")
def regions_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = raster(spark, sf_dir)
    return regions.runs(g.df.where("v > 0.05").select("x", "z"), g.meta.width)


# Symmetry.


@query("symmetry_enforce", ", o AS (SELECT a.x, a.z, a.v, b.v AS w FROM g a JOIN g b ON b.x = 63 - a.x AND b.z = (SELECT max(z) FROM g) - a.z) SELECT x, z, round(v + ((v + w) / 2 - v) * 1.0, 6) AS average, round(greatest(v, w), 6) AS max FROM o")
def symmetry_enforce(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = raster(spark, sf_dir)
    top = symmetry.enforce(g, "rotate180", "max").withColumnRenamed("v", "max")
    return cells(symmetry.enforce(g, "rotate180").withColumnRenamed("v", "average").join(top, ["x", "z"]), average="average", max="max")


@query("symmetry_error", ", o AS (SELECT a.v - b.v AS d FROM g a JOIN g b ON b.x = 63 - a.x AND b.z = a.z) SELECT round(sqrt(avg(d * d)), 6) AS rmse, round(max(abs(d)), 6) AS max_deviation FROM o")
def symmetry_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symmetry.error(raster(spark, sf_dir), "mirrorX").select(r6("rmse").alias("rmse"), r6("max_deviation").alias("max_deviation"))


@query("symmetry_error_field", ", o AS (SELECT a.x, a.z, abs(a.v - b.v) AS d FROM g a JOIN g b ON b.x = a.x AND b.z = (SELECT max(z) FROM g) - a.z) SELECT x, z, round(d, 6) AS deviation FROM o")
def symmetry_error_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(symmetry.error_field(raster(spark, sf_dir), "mirrorZ"), deviation="deviation")


@query("symmetry_detect")
def symmetry_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symmetry.detect(raster(spark, sf_dir)).select("kind", "order", r6("rmse").alias("rmse"), r6("confidence").alias("confidence"))


@query("symmetry_points", f"WITH {SPOTS} SELECT id, px AS x, pz AS z FROM sp UNION ALL SELECT id, 1024 - px, 8192 - pz FROM sp")
def symmetry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = spots(spark, sf_dir).select("id", F.explode(symmetry.point_images("rotate180", F.col("px"), F.col("pz"), 1024.0, 8192.0)).alias("p"))
    return at.select("id", "p.x", "p.z")


# Layouts.

LINE = shapes.Shape("polyline", [(50, 100), (300, 900), (450, 2000)], width=40, falloff=120, value=250.0)
RING = shapes.Shape("polygon", [(100, 1500), (400, 1500), (400, 3000), (100, 3000)], falloff=80, value=-120.0)


def PX() -> Column:
    return F.col("x") * 8.0


def PZ() -> Column:
    return F.col("z") * 8.0


def _seg_sql(ax: float, az: float, bx: float, bz: float) -> str:
    dx, dz = bx - ax, bz - az
    t = f"least(greatest(((px - {ax}) * {dx} + (pz - {az}) * {dz}) / {dx * dx + dz * dz}, 0), 1)"
    return f"sqrt((px - ({t} * {dx} + {ax})) ** 2 + (pz - ({t} * {dz} + {az})) ** 2)"


def _distance_sql(shape: shapes.Shape) -> str:
    return f"least({', '.join(_seg_sql(*s) for s in shape.segments())})"


INSIDE = "(px >= 100 AND px < 400 AND pz >= 1500 AND pz < 3000)"
LAYOUT = f"""p AS (SELECT x, z, v, x * 8.0::DOUBLE AS px, z * 8.0::DOUBLE AS pz FROM hg), e AS (SELECT *, {_distance_sql(LINE)} AS dl, {_distance_sql(RING)} AS dr FROM p),
k AS (SELECT *, CASE WHEN dl <= 20 THEN 1 ELSE {step_sql('1 - (dl - 20) / 120')} END AS cl, CASE WHEN {INSIDE} OR dr <= 0 THEN 1 ELSE {step_sql('1 - dr / 80')} END AS cr FROM e)"""


@query("layout_distance", f", {LAYOUT} SELECT x, z, round(CASE WHEN {INSIDE} THEN -1 ELSE 1 END * least(dl, dr, 500), 6) AS d FROM k")
def layout_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(raster(spark, sf_dir, 1000.0).df, d=shapes.signed_distance(PX(), PZ(), [LINE, RING], 500.0))


@query("layout_mask", f", {LAYOUT} SELECT x, z, round(greatest(cl, cr), 6) AS mask, round(CASE WHEN cl + cr > 0 THEN (cl * 250 - cr * 120) / (cl + cr) * greatest(cl, cr) ELSE 0 END, 6) AS value FROM k")
def layout_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(shapes.rasterise(raster(spark, sf_dir, 1000.0).df, PX(), PZ(), [LINE, RING]), mask="mask", value="value")


@query("layout_flatten", f", {LAYOUT}, f AS (SELECT *, v + (250 - v) * cl * 0.75 AS v1 FROM k) SELECT x, z, round(v1 + (-120 - v1) * cr * 0.75, 6) AS v FROM f")
def layout_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(shapes.apply_to_height(raster(spark, sf_dir, 1000.0).df, PX(), PZ(), [LINE, RING], "set", 0.75), v="v")


@query("layout_river")
def layout_river(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(shapes.river(raster(spark, sf_dir, 1000.0), LINE, 200.0, width=60.0, bank=100.0), v="v", channel="channel")


# Surface.

LAYERS = [
    surface.Layer("sand", (0.8, 0.7, 0.5), surface.Band(high=20, blend=20), splat=0),
    surface.Layer("grass", (0.3, 0.5, 0.2), surface.Band(0, 300, 80), surface.Band(high=1.5, blend=0.5), splat=1),
    surface.Layer("rock", (0.45, 0.43, 0.4), slope=surface.Band(low=1.0, blend=0.6), cap=0.6, splat=2),
]
_UP = lambda v, e, b: step_sql(f"({v} - {e - b / 2}) / {b}")
WEIGHTS = f"""{GRAD}, s AS (SELECT x, z, v, sqrt(gx * gx + gz * gz) AS slope FROM d),
r AS (SELECT x, z, (1 - {_UP('v', 20, 20)}) AS w0, {_UP('v', 0, 80)} * (1 - {_UP('v', 300, 80)}) * (1 - {_UP('slope', 1.5, 0.5)}) * 1.1 AS w1, {_UP('slope', 1.0, 0.6)} * 1.21 AS r2 FROM s),
w AS (SELECT x, z, w0, w1, CASE WHEN w0 + w1 > 0 THEN least(r2, (w0 + w1) * (0.6 / 0.4)) ELSE r2 END AS w2 FROM r)"""


def weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = graded(spark, sf_dir).df.withColumn("slope", stencil.slope())
    return df.select("x", "z", *[w.alias(f"w{i}") for i, w in enumerate(surface.weights(LAYERS))])


@query("surface_weights", f""", {WEIGHTS} SELECT x, z, round(w0, 6) AS w0, round(w1, 6) AS w1, round(w2, 6) AS w2,
  CASE WHEN greatest(w0, w1, w2) <= 0 THEN 0 WHEN w2 >= w0 AND w2 >= w1 THEN 2 WHEN w1 >= w0 THEN 1 ELSE 0 END AS top, round(coalesce(w1 / nullif(w0 + w1 + w2, 0), 0), 6) AS splat1 FROM w""")
def surface_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["w0", "w1", "w2"]
    df = weighted(spark, sf_dir)
    return df.select("x", "z", *[r6(n).alias(n) for n in names], surface.dominant(names).alias("top"), r6(surface.splats(LAYERS, names)[1]).alias("splat1"))


@query("surface_satmap")
def surface_satmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    red, green, blue = surface.satmap(LAYERS, ["w0", "w1", "w2"])
    return cells(weighted(spark, sf_dir), red=red, green=green, blue=blue)


# Simulations: rasters of 64 rows, one task each.


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster(spark, sf_dir, 1000.0).df.select(F.floor(F.col("z") / 64).alias("map_id"), "x", (F.col("z") % 64).alias("z"), "v")


def _kernel(name: str, run: Callable, outputs: list[str]) -> None:
    @query(name)
    def apply(spark: SparkSession, sf_dir: str) -> DataFrame:
        return kernels.on_grid(tiles(spark, sf_dir), run, outputs)


_kernel("simulate_fill", lambda a: {"filled": kernels.fill_depressions(a)}, ["filled"])
_kernel("simulate_flow", lambda a: {"flow": kernels.flow_accumulation(a), "spread": kernels.flow_accumulation(a, True)}, ["flow", "spread"])
_kernel("simulate_occlusion", lambda a: {"open": kernels.ambient_occlusion(a, 8.0, 64.0)}, ["open"])
_kernel("simulate_thermal", lambda a: {"v": kernels.thermal(a, 8.0, 35.0, 8)}, ["v"])

from cellweave.plans import extended  # noqa: E402, F401
