"""Surface materials: layer weights, caps, dominant layer, blended colours, splat channels."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellweave.functions.numeric import clamp01, hermite
from cellweave.operators.pointwise import linear_to_srgb, srgb_to_linear


@dataclass(frozen=True)
class Band:
    low: float | None = None
    high: float | None = None
    blend: float = 0.0
    blend_low: float | None = None  # of one side, in place of ``blend``
    blend_high: float | None = None

    def weight(self, v: Column) -> Column:
        out = F.lit(1.0)
        if self.low is not None:
            b = max(self.blend if self.blend_low is None else self.blend_low, 1e-9)
            out = out * hermite((v - (self.low - b / 2)) / b)
        if self.high is not None:
            b = max(self.blend if self.blend_high is None else self.blend_high, 1e-9)
            out = out * (F.lit(1.0) - hermite((v - (self.high - b / 2)) / b))
        return out

    def scaled(self, below: float, above: float) -> "Band":
        """Edges and their blends stretched by the factor of the side of zero that the edge is on."""
        def side(edge: float | None, blend: float | None) -> tuple[float | None, float | None]:
            k = below if edge is not None and edge < 0 else above
            return (None, None) if edge is None else (edge * k, (self.blend if blend is None else blend) * k)

        (low, blend_low), (high, blend_high) = side(self.low, self.blend_low), side(self.high, self.blend_high)
        return Band(low, high, 0.0, blend_low, blend_high)


@dataclass(frozen=True)
class Influence:
    channel: str
    amount: float
    start: float
    end: float

    def weight(self) -> Column:
        v = F.col(self.channel)
        s = hermite((v - self.start) / (self.end - self.start)) if self.end != self.start else F.when(v >= self.start, F.lit(1.0)).otherwise(F.lit(0.0))
        return F.lit(1 - self.amount) + s * self.amount


@dataclass(frozen=True)
class Layer:
    name: str
    color: tuple[float, float, float]
    height: Band = Band()
    slope: Band = Band()
    influences: Sequence[Influence] = ()
    weight: float = 1.0
    cap: float | None = None
    splat: int | None = None

    @property
    def capped(self) -> bool:
        return self.cap is not None and self.cap < 1

    @property
    def share(self) -> float:
        """The most weight that a capped layer may have, as a multiple of the uncapped ones."""
        return max(self.cap, 0.0) / (1 - max(self.cap, 0.0))


def rescale_heights(layers: Sequence[Layer], low: float, high: float, from_low: float, from_high: float) -> list[Layer]:
    """The layers with height bands stretched from one range to another, on each side of the water on its own."""
    if not all(map(math.isfinite, (low, high, from_low, from_high))) or high < low or from_high < from_low:
        raise ValueError("height ranges must be finite and in order")
    below = max(-low, 0.0) / -from_low if from_low < 0 else 0.0
    above = max(high, 0.0) / from_high if from_high > 0 else 0.0
    below, above = below or above, above or below
    if from_low == from_high or not above:
        return list(layers)
    return [replace(layer, height=layer.height.scaled(below, above)) for layer in layers]


def slope_bands(layers: Sequence[Layer], colors: Sequence[tuple[float, float, float]], blend: float = 2.5, strength: float = 1.6, cap: float = 0.65, splat: int | None = None) -> list[Layer]:
    """Two capped layers more: slopes that only bots climb, and slopes beyond those."""
    return [
        *layers, Layer("slope-band-bot", colors[0], slope=Band(27.0, 54.0, blend), weight=strength, cap=cap, splat=splat),
        Layer("slope-band-all-terrain", colors[1], slope=Band(low=54.0, blend=blend), weight=strength * 1.15, cap=cap, splat=splat),
    ]


def weights(layers: Sequence[Layer], height: str = "v", slope: str = "slope", exclusion: float = 1.0) -> list[Column]:
    """Raw layer weights with geometric priority, capped layers held below the uncapped sum.

    ``exclusion`` is the power of a layer's conditions (0 or less: any cell where they hold at all).
    A cap of 1 or more is none, one of 0 or less keeps the layer off all ground that another covers.
    """
    power = max(exclusion, 0.0)
    raw = []
    for i, layer in enumerate(layers):
        w = layer.height.weight(F.col(height)) * layer.slope.weight(F.col(slope))
        for influence in layer.influences:
            w = w * influence.weight()
        if power != 1:
            w = F.when(w > 0, F.pow(w, F.lit(power))).otherwise(F.lit(0.0))
        raw.append(w * (layer.weight * 1.1**i))
    free = F.lit(0.0)
    for layer, w in zip(layers, raw):
        free = free if layer.capped else free + w
    held = lambda layer, w: F.when(free > 0, F.least(w, free * layer.share)).otherwise(w) if layer.capped else w
    return [held(layer, w) for layer, w in zip(layers, raw)]


def dominant(columns: Sequence[str]) -> Column:
    """Index of the largest weight; the last of equal ones; 0 where none is positive."""
    best = F.greatest(*[F.struct(F.col(c).alias("w"), F.lit(i).alias("i")) for i, c in enumerate(columns)])
    return F.when(best["w"] > 0, best["i"]).otherwise(F.lit(0))


def satmap(layers: Sequence[Layer], columns: Sequence[str], shade: Column | None = None) -> list[Column]:
    """Layer colours blended in linear light by normalised weights, shaded, encoded."""
    total = F.lit(0.0)
    for c in columns:
        total = total + F.col(c)
    out = []
    for channel in range(3):
        mix = F.lit(0.0)
        for layer, c in zip(layers, columns):
            mix = mix + F.col(c) * srgb_to_linear(F.lit(float(layer.color[channel])))
        linear = F.coalesce(F.try_divide(mix, total), F.lit(0.0))
        out.append(clamp01(linear_to_srgb(linear * shade if shade is not None else linear)))
    return out


def splats(layers: Sequence[Layer], columns: Sequence[str]) -> list[Column]:
    """Weights routed to four channels, divided by their sum."""
    sums = [F.lit(0.0)] * 4
    for layer, c in zip(layers, columns):
        if layer.splat is not None:
            sums[layer.splat] = sums[layer.splat] + F.col(c)
    total = sums[0] + sums[1] + sums[2] + sums[3]
    return [F.coalesce(F.try_divide(s, total), F.lit(0.0)) for s in sums]


def shade(occlusion: Column, light: Column, occlusion_strength: float = 0.35, light_strength: float = 0.12) -> Column:
    return (F.lit(1.0) - (F.lit(1.0) - occlusion) * occlusion_strength) * (F.lit(1.0) - (F.lit(1.0) - light) * light_strength)

