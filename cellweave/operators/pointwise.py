"""Cell-by-cell operators as column expressions; Catalyst fuses chains of them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import ceil, floor, inf, isfinite, log10

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions.numeric import Number, clamp, clamp01, col, curve, half_up, hermite, lerp

# Fixed values of snow cover.
SNOW_BAND, SNOW_RAMP, SNOW_DRIFT = 60.0, 8.0, 24.0
#: Blend modes by name.
BLENDS: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda a, b: a + b,
    "subtract": lambda a, b: a - b,
    "multiply": lambda a, b: a * b,
    "divide": lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(F.try_divide(a, b)),
    "max": lambda a, b: F.when(a > b, a).otherwise(b),
    "min": lambda a, b: F.when(a < b, a).otherwise(b),
    "difference": lambda a, b: F.abs(a - b),
    "average": lambda a, b: (a + b) * 0.5,
    "screen": lambda a, b: F.lit(1.0) - (F.lit(1.0) - a) * (F.lit(1.0) - b),
    "overlay": lambda a, b: F.when(a < 0.5, a * b * 2).otherwise(F.lit(1.0) - (F.lit(1.0) - a) * (F.lit(1.0) - b) * 2),
}


def masked(before: Column, after: Column, mask: Number | None = None) -> Column:
    return after if mask is None else lerp(before, after, mask)


def combine(a: Column, b: Column, mode: str, factor: float = 1.0) -> Column:
    return BLENDS[mode](a, b * factor)


def height_split(a: Column, b: Column, height: float, softness: float, reference: Column | None = None) -> tuple[Column, Column]:
    half = max(softness, 1e-6) * 0.5
    mask = hermite(((reference if reference is not None else a) - (height - half)) / (2 * half))
    return lerp(a, b, mask), mask


def remap(v: Column, in_low: Number, in_high: Number, out_low: float, out_high: float) -> Column:
    span = col(in_high) - col(in_low)
    return F.when(span == 0, F.lit(float(out_low))).otherwise(F.lit(float(out_low)) + (v - col(in_low)) * F.try_divide(F.lit(float(out_high - out_low)), span))


def terrace(v: Column, steps: int, sharpness: float, low: Number, high: Number) -> Column:
    if steps < 1:
        return v
    s = min(max(sharpness, 0.0), 1.0)
    span = col(high) - col(low)
    scaled = F.try_divide(v - col(low), span) * steps
    level = F.floor(scaled)
    frac = scaled - level
    eased = F.lit(0.0) if s >= 1 else F.pow(frac, F.lit(1 / (1 - s * 0.999)))
    return F.when(span <= 0, v).otherwise(col(low) + (level + frac * (1 - s) + eased * s) / steps * span)


def apply_curve(v: Column, points: Sequence[tuple[float, float]], low: Number, high: Number) -> Column:
    span = col(high) - col(low)
    return F.when(span == 0, v).otherwise(col(low) + curve(F.try_divide(v - col(low), span), points) * span)


def clamp_soft(v: Column, low: float, high: float, softness: float) -> Column:
    low, high = min(low, high), max(low, high)
    if softness <= 0:
        return clamp(v, low, high)
    knee = lambda t: F.when(t >= 1, t).otherwise(F.exp(t - 1))
    return (
        F.when(v < low + softness, F.lit(float(low)) + knee((v - low) / softness) * softness)
        .when(v > high - softness, F.lit(float(high)) - knee((F.lit(float(high)) - v) / softness) * softness)
        .otherwise(v)
    )


def band_mask(v: Column, low: float, high: float, falloff: float) -> Column:
    f = max(falloff, 1e-9)
    t = F.when(v < low, (v - (low - f)) / f).when(v > high, (F.lit(high + f) - v) / f).otherwise(F.lit(1.0))
    return hermite(t)


def math(v: Column, operation: str, k: float = 1.0) -> Column:
    return {
        "multiply": lambda: v * k,
        "add": lambda: v + k,
        "power": lambda: F.signum(v) * F.pow(F.abs(v), F.lit(float(k))),
        "abs": lambda: F.abs(v),
        "negate": lambda: -v,
        "oneMinus": lambda: F.lit(1.0) - v,
        "floor": lambda: F.floor(v / k) * k,
        "step": lambda: F.when(v >= k, F.lit(1.0)).otherwise(F.lit(0.0)),
    }[operation]()


def ramp(u: Column, w: Column, direction: str, falloff: str = "smooth", centre: tuple[float, float] = (0.5, 0.5), low: float = 0.0, high: float = 1.0) -> Column:
    """A gradient over corner-aligned coordinates u, w in 0..1."""
    dx, dz = (u - centre[0]) * 2, (w - centre[1]) * 2
    t = {
        "x": lambda: F.lit(1.0) - u,
        "z": lambda: F.lit(1.0) - w,
        "diagonal": lambda: F.lit(1.0) - (u + w) * 0.5,
        "box": lambda: F.lit(1.0) - F.least(F.lit(1.0), F.greatest(F.abs(dx), F.abs(dz))),
        "radial": lambda: F.lit(1.0) - F.least(F.lit(1.0), F.sqrt(dx * dx + dz * dz)),
    }[direction]()
    c = clamp01(t)
    shaped = {"linear": lambda: c, "sharp": lambda: F.lit(1.0) - F.pow(F.lit(1.0) - c, F.lit(3.0)), "smooth": lambda: hermite(c)}[falloff]()
    return F.lit(float(low)) + shaped * (high - low)


# Aggregates that a cell operator needs, as one broadcast row.


def ranged(df: DataFrame, v: str = "v") -> DataFrame:
    """``df`` with the raster's ``lo`` and ``hi`` on every row (0 for an empty raster)."""
    one = df.agg(F.coalesce(F.min(v), F.lit(0.0)).alias("lo"), F.coalesce(F.max(v), F.lit(0.0)).alias("hi"))
    return df.join(F.broadcast(one))  # one row


def statistics(df: DataFrame, v: str = "v") -> DataFrame:
    return df.agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), (F.max(v) - F.min(v)).alias("range"))


def nearest_rank(df: DataFrame, fraction: float, v: str = "v", bins: int = 4096) -> float:
    """The value at index round(fraction * (n - 1)) of the sorted values.

    A histogram finds the bin of that rank, again inside the bin, and so on; no
    global sort and no single-task window.  Ends on a bin of one value.
    """
    n, low, high = df.agg(F.count(v), F.min(v), F.max(v)).first()
    if not n:
        return 0.0
    rank, rows = min(n - 1, max(0, int(fraction * (n - 1) + 0.5))), df
    while low < high:
        width = (high - low) / bins
        if width == 0 or low + width == low:
            break
        at = F.least(F.floor((F.col(v) - low) / width), F.lit(bins - 1))
        counts = rows.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).orderBy("bin").collect()
        for r in counts:  # at most ``bins`` rows
            if rank < r["n"]:
                low, high = r["lo"], r["hi"]
                break
            rank -= r["n"]
        rows = rows.where(F.col(v).between(low, high))
    return float(low)


def sea_level(df: DataFrame, fraction: float, v: str = "v") -> DataFrame:
    shore = nearest_rank(df, fraction, v)
    out = F.col(v) - shore
    return df.select("x", "z", out.alias("v"), F.when(out >= 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("land"))


def flatten(df: DataFrame, mode: str, strength: float, target: float = 0.0, v: str = "v", weight: str | None = None) -> DataFrame:
    w = F.col(weight) if weight else F.lit(1.0)
    if mode == "fixed":
        goal, rows = F.lit(float(target)), df
    else:
        used = F.when(w > 0, F.col(v))
        stat = {"average": F.try_divide(F.sum(used * w), F.sum(F.when(w > 0, w))), "lowest": F.min(used), "highest": F.max(used)}[mode]
        rows, goal = df.join(F.broadcast(df.agg(stat.alias("_goal")))), F.col("_goal")
    return rows.select("x", "z", F.when(goal.isNull(), F.col(v)).otherwise(F.col(v) + (goal - F.col(v)) * w * strength).alias("v"))


def output_texture(r: Column, g: Column, b: Column, brightness: float, contrast: float, saturation: float) -> list[Column]:
    """Brightness, contrast about one half, saturation about Rec. 709 luma, clamp."""
    lit = [((c * brightness) - 0.5) * contrast + 0.5 for c in (r, g, b)]
    luma = lit[0] * 0.2126 + lit[1] * 0.7152 + lit[2] * 0.0722
    return [clamp01(luma + (c - luma) * saturation) for c in lit]


def output_metal(v: Column, scale: float, threshold: float) -> Column:
    scaled = v * scale
    return F.when(scaled < threshold, F.lit(0.0)).otherwise(clamp01(scaled))


def output_terrain_type(v: Column, mode: str) -> Column:
    return v if mode == "index" else half_up(clamp01(v) * 255)


def snow_cover(v: Column, slope_degrees: Column, line: float, limit: float) -> Column:
    """A step of ``SNOW_BAND`` units above the line, times a ramp of ``SNOW_RAMP`` degrees below the limit."""
    return hermite((v - line) / SNOW_BAND) * clamp01((F.lit(float(limit)) - slope_degrees) / SNOW_RAMP)


def quantise(v: Column, low: float, high: float) -> Column:
    """16-bit raw heights; the divisor is 65,536."""
    return clamp(half_up((v - low) / (high - low) * 65536), 0, 65535)


def dequantise(raw: Column, low: float, high: float) -> Column:
    return F.lit(float(low)) + raw / 65536.0 * (high - low)


def srgb_to_linear(c: Column) -> Column:
    c = clamp01(c)
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(c: Column) -> Column:
    c = clamp01(c)
    return F.when(c <= 0.0031308, c * 12.92).otherwise(F.pow(c, F.lit(1 / 2.4)) * 1.055 - 0.055)


def suggest_range(low: float | None, high: float | None, padding: float = 0.02) -> tuple[float, float]:
    """A declared height range with round ends around the raster's smallest and largest value."""
    if low is None or high is None or not all(map(isfinite, (low, high))):
        return 0.0, 256.0
    high = low + 1 if high == low else high
    pad = (high - low) * padding
    size = 10.0 ** (floor(log10(max(high - low, 1e-6))) - 1)
    step = size * next(factor for bound, factor in ((15, 1.0), (35, 2.5), (75, 5.0), (inf, 10.0)) if (high - low) / size < bound)
    return floor((low - pad) / step) * step, ceil((high + pad) / step) * step
