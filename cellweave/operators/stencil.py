"""Neighbourhood operators: window frames along rows, then along columns, inside tiles with a halo."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.operators.grid import Grid, along_x, along_z, in_tiles, neighbour
from cellweave.operators.pointwise import SNOW_DRIFT, snow_cover


def gradient(grid: Grid, v: str = "v") -> Grid:
    """``gx`` and ``gz``: central differences over two cells, also at held edges."""
    c = 2 * grid.meta.cell
    return in_tiles(grid, 1, lambda g: g.with_columns({
        "gx": (neighbour(v, 1) - neighbour(v, -1)) / c,
        "gz": (neighbour(v, 0, 1) - neighbour(v, 0, -1)) / c,
    }))


def slope(gx: str = "gx", gz: str = "gz") -> Column:
    return F.sqrt(F.col(gx) * F.col(gx) + F.col(gz) * F.col(gz))


def slope_degrees(gx: str = "gx", gz: str = "gz") -> Column:
    return F.degrees(F.atan(slope(gx, gz)))


def aspect(gx: str = "gx", gz: str = "gz") -> Column:
    return F.atan2(F.col(gz), F.col(gx))


def hillshade(azimuth: float, altitude: float, exaggeration: float = 1.0) -> Column:
    """Lambert shade of ``gx``, ``gz``; angles in degrees, compass azimuth."""
    az, alt = math.radians(azimuth), math.radians(altitude)
    lx, ly, lz = math.sin(az) * math.cos(alt), math.sin(alt), -math.cos(az) * math.cos(alt)
    nx, nz = -F.col("gx") * exaggeration, -F.col("gz") * exaggeration
    return F.greatest(F.lit(0.0), (nx * lx + F.lit(ly) + nz * lz) / F.sqrt(nx * nx + 1 + nz * nz))


def normal_map(strength: float = 1.0) -> list[Column]:
    """Tangent-space normal of ``gx``, ``gz`` encoded in 0..1."""
    nx, nz = -F.col("gx") * strength, -F.col("gz") * strength
    size = F.sqrt(nx * nx + nz * nz + 1)
    return [nx / size * 0.5 + 0.5, nz / size * 0.5 + 0.5, F.lit(1.0) / size * 0.5 + 0.5]


def curvature(grid: Grid, v: str = "v") -> Grid:
    """``mean``, ``gaussian``, ``planform`` and ``profile`` curvature."""
    return in_tiles(grid, 1, lambda g: _curvature(g, v))


def _curvature(grid: Grid, v: str) -> Grid:
    c = grid.meta.cell
    rows = grid.with_columns({"_e": neighbour(v, 1), "_w": neighbour(v, -1)})
    rows = rows.with_columns({
        "_n": neighbour(v, 0, -1), "_s": neighbour(v, 0, 1),
        "_ne": neighbour("_e", 0, -1), "_se": neighbour("_e", 0, 1),
        "_nw": neighbour("_w", 0, -1), "_sw": neighbour("_w", 0, 1),
    })
    k = F.col
    zx, zy = (k("_e") - k("_w")) / (2 * c), (k("_s") - k("_n")) / (2 * c)
    zxx, zyy = (k("_e") - k(v) * 2 + k("_w")) / (c * c), (k("_s") - k(v) * 2 + k("_n")) / (c * c)
    zxy = (k("_se") - k("_ne") - k("_sw") + k("_nw")) / (4 * c * c)
    rows = rows.with_columns({"_zx": zx, "_zy": zy, "_zxx": zxx, "_zyy": zyy, "_zxy": zxy})
    x, y, xx, yy, xy = (k(n) for n in ("_zx", "_zy", "_zxx", "_zyy", "_zxy"))
    p, q = x * x + y * y, x * x + y * y + 1
    flat = lambda value: F.when(p == 0, F.lit(0.0)).otherwise(value)
    return rows.with_columns({
        "mean": ((y * y + 1) * xx - x * y * xy * 2 + (x * x + 1) * yy) / (F.pow(q, F.lit(1.5)) * 2),
        "gaussian": (xx * yy - xy * xy) / (q * q),
        "planform": flat(-F.try_divide(y * y * xx - x * y * xy * 2 + x * x * yy, F.pow(p, F.lit(1.5)))),
        "profile": flat(-F.try_divide(x * x * xx + x * y * xy * 2 + y * y * yy, p * F.pow(q, F.lit(1.5)))),
    })


def _box(v: str, r: int, window, place: str, size: int) -> Column:
    """Mean of ``2 r + 1`` cells with held edges: a frame sum, plus the edge cells that are missing."""
    inside = F.sum(v).over(window.rowsBetween(-r, r))
    whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(v).over(whole), F.last(v).over(whole)
    before = F.greatest(F.lit(0), F.lit(r) - F.col(place))
    after = F.greatest(F.lit(0), F.col(place) + r - (size - 1))
    return (inside + first * before + last * after) / (2 * r + 1)


def _blurred(grid: Grid, r: int, v: str) -> Grid:
    return grid.with_column(v, _box(v, r, along_x(), "x", grid.meta.width)).with_column(v, _box(v, r, along_z(), "z", grid.meta.height))


def box_blur(grid: Grid, radius: float, v: str = "v") -> Grid:
    r = max(0, int(radius + 0.5))
    return in_tiles(grid, r, lambda g: _blurred(g, r, v)) if r else grid


def gaussian_widths(sigma: float, n: int = 3) -> list[int]:
    """Widths of ``n`` boxes whose variance is nearest to sigma squared."""
    ideal = math.sqrt(12 * sigma * sigma / n + 1)
    low = int(math.floor(ideal))
    low -= low % 2 == 0
    lower = math.floor((12 * sigma * sigma - n * low * low - 4 * n * low - 3 * n) / (-4 * low - 4) + 0.5)
    return [low if i < lower else low + 2 for i in range(n)]


def gaussian_blur(grid: Grid, sigma: float, v: str = "v") -> Grid:
    radii = [r for r in ((w - 1) // 2 for w in gaussian_widths(sigma)) if r] if sigma > 0 else []

    def run(g: Grid) -> Grid:
        for r in radii:
            g = _blurred(g, r, v)
        return g

    return in_tiles(grid, sum(radii), run) if radii else grid


def unsharp(grid: Grid, sigma: float, amount: float) -> Grid:
    blurred = gaussian_blur(grid.with_column("_b", F.col("v")), sigma, "_b")
    return blurred.with_column("v", F.col("v") + (F.col("v") - F.col("_b")) * amount)


def dilate(grid: Grid, r: int, v: str = "v") -> Grid:
    wide = lambda w: F.max(v).over(w.rowsBetween(-r, r))
    return in_tiles(grid, r, lambda g: g.with_column(v, wide(along_x())).with_column(v, wide(along_z())))


def window_extrema(grid: Grid, wx: int, wz: int, v: str = "v") -> DataFrame:
    """Smallest and largest value of every ``wx`` by ``wz`` window that lies inside, keyed by its first corner."""
    return in_tiles(grid, max(wx, wz) - 1, lambda g: _extrema(g, wx, wz, v))


def _extrema(grid: Grid, wx: int, wz: int, v: str) -> DataFrame:
    rows = grid.df.withColumns({"_lo": F.min(v).over(along_x().rowsBetween(0, wx - 1)), "_hi": F.max(v).over(along_x().rowsBetween(0, wx - 1))})
    rows = rows.where(F.col("x") <= grid.meta.width - wx)
    rows = rows.withColumns({"lo": F.min("_lo").over(along_z().rowsBetween(0, wz - 1)), "hi": F.max("_hi").over(along_z().rowsBetween(0, wz - 1))})
    return rows.where(F.col("z") <= grid.meta.height - wz).drop("_lo", "_hi")


def square_centres(grid: Grid, v: str = "v") -> Grid:
    """Mean of the four corners of every square; one sample less each way."""
    return in_tiles(grid, 1, lambda g: _centres(g, v))


def _centres(grid: Grid, v: str) -> Grid:
    rows = grid.df.withColumn("_r", F.lead(v).over(along_x()))
    rows = rows.withColumns({"_d": F.lead(v).over(along_z()), "_rd": F.lead("_r").over(along_z())})
    rows = rows.where(F.col("_r").isNotNull() & F.col("_rd").isNotNull())
    meta = type(grid.meta)(grid.meta.width - 1, grid.meta.height - 1, grid.meta.cell)
    return Grid(rows.select("_tx", "_tz", "x", "z", ((F.col(v) + F.col("_r") + F.col("_d") + F.col("_rd")) * 0.25).alias("v")), meta)


def downsample_half(df: DataFrame, v: str = "v") -> DataFrame:
    return df.groupBy(F.floor(F.col("x") / 2).alias("x"), F.floor(F.col("z") / 2).alias("z")).agg(F.avg(v).alias("v"))


def resample_shrink(grid: Grid, width: int, height: int) -> Grid:
    """Box means over index ranges; a source cell may feed several targets, never all."""
    meta = grid.meta

    def targets(at: Column, source: int, target: int) -> Column:
        # cells [floor(t * s), max(start + 1, ceil((t + 1) * s))) feed target t, s = source / target
        low = F.greatest(F.lit(0), F.floor(at * (target / source)).cast("int") - 1)
        high = F.least(F.lit(target - 1), F.ceil((at + 1) * (target / source)).cast("int"))
        start = lambda t: F.floor(t * (source / target))
        stop = lambda t: F.greatest(start(t) + 1, F.ceil((t + 1) * (source / target)))
        return F.filter(F.sequence(low, high), lambda t: (start(t) <= at) & (at < stop(t)))

    rows = grid.df.select(F.explode(targets(F.col("x"), meta.width, width)).alias("tx"), "z", "v")
    rows = rows.select("tx", F.explode(targets(F.col("z"), meta.height, height)).alias("tz"), "v")
    out = rows.groupBy(F.col("tx").cast("long").alias("x"), F.col("tz").cast("long").alias("z")).agg(F.avg("v").alias("v"))
    return Grid(out, type(meta)(width, height, meta.cell * meta.width / width))


def bilinear(grid: Grid, at: DataFrame, v: str = "v") -> DataFrame:
    """Samples of ``grid`` at (sx, sz), held at the edges; ``at`` keeps its columns and gets ``v``.

    Every sample point asks for its four cells by one equi-join on cells.
    """
    w, h = grid.meta.width, grid.meta.height
    put = at.withColumns({"_id": F.monotonically_increasing_id(), "_fx": F.col("sx") - F.floor("sx"), "_fz": F.col("sz") - F.floor("sz")})
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])).alias("_c")
    need = put.select("*", corner)
    hold = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), c)).cast("long")
    need = need.withColumns({"_x": hold(F.floor("sx") + F.col("_c.i"), w), "_z": hold(F.floor("sz") + F.col("_c.j"), h)})
    weight = F.when(F.col("_c.i") == 1, F.col("_fx")).otherwise(F.lit(1.0) - F.col("_fx")) * F.when(F.col("_c.j") == 1, F.col("_fz")).otherwise(F.lit(1.0) - F.col("_fz"))
    cells = grid.df.select(F.col("x").alias("_x"), F.col("z").alias("_z"), F.col(v).alias("_v"))
    keys = [c for c in at.columns]
    return need.join(cells, ["_x", "_z"]).groupBy("_id", *keys).agg(F.sum(F.col("_v") * weight).alias("v")).drop("_id")


def snow(grid: Grid, line: float = 400.0, limit: float = 45.0, thickness: float = 8.0, settle: float = 0.5) -> Grid:
    """``v`` with snow on it, and ``cover``; drifting keeps the larger of the cover and a blur of it."""
    out = gradient(grid)
    out = out.with_column("cover", snow_cover(F.col("v"), slope_degrees(), line, limit))
    if settle > 0:
        out = gaussian_blur(out.with_column("_drift", F.col("cover")), SNOW_DRIFT / grid.meta.cell, "_drift")
        out = out.with_column("cover", F.greatest(F.col("cover"), F.col("_drift") * settle))
    return Grid(out.df.select("x", "z", (F.col("v") + F.col("cover") * thickness).alias("v"), "cover"), grid.meta)


def transform(grid: Grid, dx: float, dz: float, scale: float, rotation: float) -> DataFrame:
    """Rotate, scale and shift about the middle (width / 2), sampling bilinearly."""
    cx, cz, co, si = grid.meta.width / 2, grid.meta.height / 2, math.cos(rotation), math.sin(rotation)
    px, pz = (F.col("x") - cx) / scale, (F.col("z") - cz) / scale
    at = grid.df.select("x", "z", (F.lit(cx) + px * co - pz * si + dx).alias("sx"), (F.lit(cz) + px * si + pz * co + dz).alias("sz"))
    return bilinear(grid, at).select("x", "z", "v")


def warp(grid: Grid, by: str, amount: float) -> DataFrame:
    """Displace samples along the gradient of channel ``by``; held edges keep the two-cell divisor."""
    moved = in_tiles(grid, 1, lambda g: g.with_columns({"_gx": (neighbour(by, 1) - neighbour(by, -1)) * 0.5, "_gz": (neighbour(by, 0, 1) - neighbour(by, 0, -1)) * 0.5}))
    at = moved.df.select("x", "z", (F.col("x") + F.col("_gx") * amount).alias("sx"), (F.col("z") + F.col("_gz") * amount).alias("sz"))
    return bilinear(grid, at).select("x", "z", "v")
