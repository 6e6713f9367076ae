"""Derived surface channels: flow, wetness, deposition, wear, aspect, macro, curvature.

Each is a lazy column of 0..1; Catalyst computes only those that a palette reads.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions.numeric import clamp01, hermite
from cellweave.operators.grid import Grid, GridMeta
from cellweave.operators.stencil import dilate, gaussian_blur

# Fixed values.
CHANNEL_WIDTH, CHANNEL_SHARE, DECADES = 7, 0.0015, 2
CURVATURE_SCALE = 0.02
COMMITTED = 0.466
MACRO_SIZE = 1400.0


def flatness(degrees: Column, limit: float) -> Column:
    """1 on level ground, 0 at ``limit`` degrees and steeper."""
    return hermite(F.lit(1.0) - degrees / limit)


def convexity(profile: Column) -> Column:
    return clamp01((profile / CURVATURE_SCALE + 1) * 0.5)


def wetness(height: Column, degrees: Column, flow: Column, water: float = 0.0) -> Column:
    wet = F.least(F.lit(1.0), flatness(degrees, 28) * 0.5 + flow * 0.6)
    return F.when(height <= water, F.lit(1.0)).otherwise(wet)


def deposition(degrees: Column, convex: Column) -> Column:
    return flatness(degrees, 25) * (F.lit(1.0) - convex)


def wear(degrees: Column, convex: Column) -> Column:
    return (F.lit(1.0) - flatness(degrees, 45)) * convex


def facing(gx: Column, gz: Column) -> Column:
    """0 due south, 1 due north, 0.5 flat or between; committed from 25 degrees on."""
    steep = F.hypot(gx, gz)
    north = F.when(steep > 1e-9, F.try_divide(gz, steep)).otherwise(F.lit(0.0))
    return F.lit(0.5) + north * F.least(F.lit(1.0), steep / COMMITTED) * 0.5


def channel_mask(drained: Column, meta: GridMeta, share: float = CHANNEL_SHARE) -> Column:
    """Drained cells (itself included) as a mask: log area over two decades above the map's threshold."""
    start = (share if share > 0 else 5e-324) * meta.width * meta.height * meta.cell * meta.cell
    area = (drained - 1) * (meta.cell * CHANNEL_WIDTH)
    t = (F.log(F.greatest(area, F.lit(start))) - math.log(start)) / (DECADES * math.log(10))
    return F.when(area > start, hermite(t)).otherwise(F.lit(0.0))


def flow_channel(grid: Grid, drained: str = "flow") -> Grid:
    """``flow`` as a channel mask, widened to the channels' width where cells are small."""
    out = grid.with_column(drained, channel_mask(F.col(drained), grid.meta))
    r = max(0, math.floor((CHANNEL_WIDTH / grid.meta.cell - 1) / 2))
    return gaussian_blur(dilate(out, r, drained), r * 0.5, drained) if r else out


def spread_to_range(df: DataFrame, v: str) -> DataFrame:
    """``v`` stretched to 0..1 over the map; 0.5 where it hardly varies."""
    one = df.agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    out = F.when(span > 1e-6, F.try_divide(F.col(v) - F.col("_lo"), span)).otherwise(F.lit(0.5))
    return df.join(F.broadcast(one)).withColumn(v, out).drop("_lo", "_hi")


def channels_used(layers: Sequence) -> set[str]:
    """The channels that a palette's layers read."""
    return {i.channel for layer in layers for i in layer.influences}
