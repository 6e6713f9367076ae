"""Lattice noises and their fractal sums, as NumPy on Arrow batches.

Noise is a pure function of coordinates and seed, so partitioning never matters.
As nested Catalyst expressions the hashes multiply beyond what code generation
takes (a lattice noise needs four hashes, each with its operand several times),
so the kernel is one vectorised UDF per raster, however many octaves.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the hashes and gradients.
MIX_A, MIX_B = 0x21F0AAAD, 0xD35A2D97
SALT_X, SALT_Y, SALT_SEED = 0x27D4EB2D, 0x85EBCA6B, 0xC2B2AE35
OCTAVE_SEED = 0x9E3779B9
OCTAVE_SHIFT = (17.13, 31.77)
DIAGONAL = 0.7071
GRADIENTS = np.array(
    [(1, 0), (-1, 0), (0, 1), (0, -1), (DIAGONAL, DIAGONAL), (-DIAGONAL, DIAGONAL), (DIAGONAL, -DIAGONAL), (-DIAGONAL, -DIAGONAL)], np.float32
).astype(np.float64)

Array = np.ndarray


def _u32(n: int) -> np.uint32:
    return np.uint32(n & 0xFFFFFFFF)


def hash32(h: Array) -> Array:
    """32-bit avalanche of uint32 values."""
    h = (h ^ (h >> _u32(16))) * _u32(MIX_A)
    h = (h ^ (h >> _u32(15))) * _u32(MIX_B)
    return h ^ (h >> _u32(15))


def hash2(x: Array, y: Array, seed: int) -> Array:
    """Hash of integer coordinates and a seed, as uint32."""
    word = lambda a: a.astype(np.int64).astype(np.uint32)
    return hash32(word(x) * _u32(SALT_X) ^ word(y) * _u32(SALT_Y) ^ _u32((seed & 0xFFFFFFFF) * SALT_SEED))


def _lattice(x: Array, y: Array, corner) -> Array:
    xi, yi = np.floor(x), np.floor(y)
    fx, fy = x - xi, y - yi
    u, v = (t * t * t * (t * (t * 6 - 15) + 10) for t in (fx, fy))
    low, high = (corner(xi, yi + j, fx, fy - j) * (1 - u) + corner(xi + 1, yi + j, fx - 1, fy - j) * u for j in (0, 1))
    return low + (high - low) * v


def value_noise(x: Array, y: Array, seed: int) -> Array:
    return _lattice(x, y, lambda i, j, dx, dy: hash2(i, j, seed) / 4294967296.0 * 2 - 1)


def _slope(i: Array, j: Array, dx: Array, dy: Array, seed: int) -> Array:
    g = GRADIENTS[hash2(i, j, seed) & 7]
    return g[..., 0] * dx + g[..., 1] * dy


def perlin(x: Array, y: Array, seed: int) -> Array:
    return _lattice(x, y, lambda i, j, dx, dy: _slope(i, j, dx, dy, seed)) * 1.4142135


def simplex(x: Array, y: Array, seed: int) -> Array:
    skew, back = 0.5 * (3**0.5 - 1), (3 - 3**0.5) / 6
    i, j = np.floor(x + (x + y) * skew), np.floor(y + (x + y) * skew)
    x0, y0 = x - (i - (i + j) * back), y - (j - (i + j) * back)
    right = (x0 > y0).astype(float)
    total = np.zeros_like(x0)
    for a, b, n in ((0 * right, 0 * right, 0), (right, 1 - right, 1), (1 + 0 * right, 1 + 0 * right, 2)):
        dx, dy = x0 - a + n * back, y0 - b + n * back
        t = np.maximum(0.5 - dx * dx - dy * dy, 0)
        total += t**4 * _slope(i + a, j + b, dx, dy, seed)
    return 70 * total


def worley(x: Array, y: Array, seed: int) -> tuple[Array, Array, Array]:
    """Distances to the nearest two feature points and the hash of the nearest."""
    xi, yi, d, c = np.floor(x), np.floor(y), [], []
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            h = hash2(xi + dx, yi + dy, seed)
            d.append(np.hypot(xi + dx + (h & 0xFFFF) / 65536 - x, yi + dy + (h >> _u32(16)) / 65536 - y))
            c.append((h & 0xFFFFFF) / 16777216)
    d, c = np.array(d), np.array(c)
    first = d.argmin(0)[None]
    near = np.sort(d, axis=0)
    return near[0], near[1], np.take_along_axis(c, first, 0)[0]


def worley_scalar(x: Array, y: Array, seed: int, metric: str = "f1") -> Array:
    f1, f2, cell = worley(x, y, seed)
    return {"f1": np.minimum(f1, 1) * 2 - 1, "f2": np.minimum(f2, 1.5) / 0.75 - 1, "f2-f1": np.minimum(f2 - f1, 1) * 2 - 1, "cell": cell * 2 - 1}[metric]


BASES = {"value": value_noise, "perlin": perlin, "simplex": simplex, "worley": worley_scalar}


@dataclass(frozen=True)
class Noise:
    fractal: str = "fbm"  # fbm, ridged, billow, hybrid, multiply
    basis: str = "perlin"
    frequency: float = 1.0
    octaves: int = 4
    gain: float = 0.5
    lacunarity: float = 2.0
    sharpness: float = 0.625
    seed: int = 1


def fractal_values(x: Array, y: Array, p: Noise) -> Array:
    total, norm, weight, freq, amp = np.zeros_like(x), np.zeros_like(x), np.ones_like(x), p.frequency, 1.0
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        for o in range(p.octaves):
            n = BASES[p.basis](x * freq + o * OCTAVE_SHIFT[0], y * freq + o * OCTAVE_SHIFT[1], p.seed + o * OCTAVE_SEED)
            if p.fractal == "multiply":
                total, norm = (n if o == 0 else total * (0.5 + 0.5 * n)), np.ones_like(x)
            elif p.fractal == "ridged":
                edge = (1 - np.minimum(1, np.abs(n) * (0.5 + p.sharpness * 1.6))) ** 2
                total, norm = total + edge * weight * amp, norm + amp
                weight = np.clip(edge * (1 + 2 * p.gain), 0, 1)
            elif p.fractal == "hybrid":
                signal = (n + 1) * 0.5
                total, norm = total + signal * weight * amp, norm + weight * amp
                weight = np.clip(weight * signal * 2, 0.15, 1)
            else:
                total, norm = total + (np.abs(n) * 2 - 1 if p.fractal == "billow" else n) * amp, norm + amp
            freq, amp = freq * p.lacunarity, amp * p.gain
        return np.where(norm == 0, 0.0, total / norm)


def fractal(x: Column, y: Column, p: Noise) -> Column:
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(fractal_values(a.to_numpy(float), b.to_numpy(float), p))

    return F.pandas_udf(run, "double")(x, y)


def warped(x: Column, y: Column, base: Noise, by_x: Noise, by_y: Noise, amount: float) -> Column:
    """One domain-warp step: sample where two other noises point."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        u, w = a.to_numpy(float), b.to_numpy(float)
        return pd.Series(fractal_values(u + fractal_values(u, w, by_x) * amount, w + fractal_values(u + 3.1, w + 7.7, by_y) * amount, base))

    return F.pandas_udf(run, "double")(x, y)
