"""Scalar building blocks as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Number = Column | float | int


def col(x: Number) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def clamp(v: Column, low: Number, high: Number) -> Column:
    return F.least(F.greatest(v, col(low)), col(high))


def clamp01(v: Column) -> Column:
    return clamp(v, 0.0, 1.0)


def hermite(t: Column) -> Column:
    """t * t * (3 - 2 t) with t held in 0..1."""
    c = clamp01(t)
    return c * c * (F.lit(3.0) - F.lit(2.0) * c)


def half_up(v: Column) -> Column:
    """Rounds halves up, also below zero (-2.5 gives -2)."""
    return F.floor(v + 0.5)


def smoothstep(v: Column, edge0: float, edge1: float) -> Column:
    if edge0 == edge1:
        return F.when(v < edge0, F.lit(0.0)).otherwise(F.lit(1.0))
    return hermite((v - edge0) / (edge1 - edge0))


def lerp(a: Column, b: Number, t: Number) -> Column:
    return a + (col(b) - a) * col(t)


def int32(v: Column) -> Column:
    """A long wrapped to 32 signed bits."""
    return F.shiftright(F.shiftleft(v, 32), 32)


def uint32(v: Column) -> Column:
    return v.bitwiseAND(F.lit(0xFFFFFFFF))


def imul(a: Column, b: int) -> Column:
    """32-bit product: the constant is split so that no partial product overflows a long."""
    b &= 0xFFFFFFFF
    low, high = b & 0xFFFF, b >> 16
    x = uint32(a)
    return int32(x * F.lit(low) + F.shiftleft(uint32(x * F.lit(high)).bitwiseAND(F.lit(0xFFFF)), 16))


def curve(v: Column, points: Sequence[tuple[float, float]]) -> Column:
    """Piecewise cubic through ``points`` with harmonic-mean tangents and flat ends, as one CASE."""
    pts = [(float(x), float(y)) for x, y in points]
    if not pts:
        return v
    if len(pts) == 1:
        return F.lit(pts[0][1])
    rise = [(b[1] - a[1]) / (b[0] - a[0]) if b[0] != a[0] else 0.0 for a, b in zip(pts, pts[1:])]
    inner = [2 * p * q / (p + q) if p * q > 0 else 0.0 for p, q in zip(rise, rise[1:])]
    tangent = [rise[0], *inner, rise[-1]]
    out = F.when(v <= pts[0][0], F.lit(pts[0][1])).when(v >= pts[-1][0], F.lit(pts[-1][1]))
    for i, ((x0, y0), (x1, y1)) in enumerate(zip(pts, pts[1:])):
        h = x1 - x0
        if h <= 0:
            out = out.when(v <= x1, F.lit(y1))
            continue
        t = (v - x0) / h
        t2, t3 = t * t, t * t * t
        piece = (t3 * 2 - t2 * 3 + 1) * y0 + (t3 - t2 * 2 + t) * (h * tangent[i]) + (t2 * 3 - t3 * 2) * y1 + (t3 - t2) * (h * tangent[i + 1])
        out = out.otherwise(piece) if i == len(pts) - 2 else out.when(v <= x1, piece)
    return out


def gradient(v: Column, stops: Sequence[tuple[float, Sequence[float]]], channel: int) -> Column:
    """One channel of a colour ramp."""
    out = F.when(v <= stops[0][0], F.lit(float(stops[0][1][channel])))
    for (p0, c0), (p1, c1) in zip(stops, stops[1:]):
        k = (v - p0) / (p1 - p0) if p1 > p0 else F.lit(1.0)
        out = out.when(v <= p1, F.lit(float(c0[channel])) + k * float(c1[channel] - c0[channel]))
    return out.otherwise(F.lit(float(stops[-1][1][channel])))
