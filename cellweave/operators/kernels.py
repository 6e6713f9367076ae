"""Sequential simulations as NumPy kernels on one simulation grid.

These depend on visiting order or on the whole grid, so they run on a raster of
at most ``MAX_SIDE`` samples a side (the simulation grid), one task a raster;
many rasters (tiles, maps) run in parallel by their key.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

MAX_SIDE = 1025
#: Fixed order: east, then clockwise (z grows to the south); of equal drops the first is taken.
AROUND = [(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)]


def on_grid(df: DataFrame, kernel: Callable[[np.ndarray], dict[str, np.ndarray]], outputs: list[str], key: str = "map_id") -> DataFrame:
    """Apply ``kernel`` to each raster (key, x, z, v) of ``df``; one column an output."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        w, h = int(part["x"].max()) + 1, int(part["z"].max()) + 1
        if max(w, h) > MAX_SIDE:
            raise ValueError(f"a simulation grid has at most {MAX_SIDE} samples a side")
        a = np.zeros((h, w))
        a[part["z"], part["x"]] = part["v"]
        out = kernel(a)
        return pd.DataFrame({key: part[key], "x": part["x"], "z": part["z"], **{n: out[n][part["z"], part["x"]] for n in outputs}})

    kind = df.schema[key].dataType.simpleString()
    return df.groupBy(key).applyInPandas(run, f"{key} {kind}, x long, z long, " + ", ".join(f"{n} double" for n in outputs))


def fill_depressions(a: np.ndarray, epsilon: float = 1e-4) -> np.ndarray:
    """Raise cells so that every cell drains to the border (priority flood)."""
    h, w = a.shape
    out, seen, heap = a.copy(), np.zeros(a.shape, bool), []
    for z in range(h):
        for x in range(w):
            if z in (0, h - 1) or x in (0, w - 1):
                seen[z, x] = True
                heapq.heappush(heap, (a[z, x], z, x))
    while heap:
        level, z, x = heapq.heappop(heap)
        for dx, dz in AROUND:
            i, j = z + dz, x + dx
            if 0 <= i < h and 0 <= j < w and not seen[i, j]:
                seen[i, j] = True
                out[i, j] = max(a[i, j], level + epsilon)
                heapq.heappush(heap, (out[i, j], i, j))
    return out


def flow_accumulation(a: np.ndarray, spread: bool = False, exponent: float = 1.1) -> np.ndarray:
    """Cells that drain through each cell: steepest descent, or shared by drop over distance."""
    f = fill_depressions(a)
    h, w = f.shape
    flow = np.ones(f.shape)
    for at in np.argsort(-f, axis=None, kind="stable"):
        z, x = divmod(int(at), w)
        drops = []
        for dx, dz in AROUND:
            i, j = z + dz, x + dx
            if 0 <= i < h and 0 <= j < w and f[i, j] < f[z, x]:
                drops.append(((f[z, x] - f[i, j]) / np.hypot(dx, dz), i, j))
        if not drops:
            continue
        if spread:
            total = sum(d**exponent for d, _, _ in drops)
            for d, i, j in drops:
                flow[i, j] += flow[z, x] * d**exponent / total
        else:
            _, i, j = max(drops, key=lambda d: d[0])
            flow[i, j] += flow[z, x]
    return flow


def ambient_occlusion(a: np.ndarray, cell: float, radius: float, directions: int = 12, steps: int = 16, intensity: float = 1.0) -> np.ndarray:
    """1 minus the mean sine of horizon angles."""
    h, w = a.shape
    zz, xx = np.mgrid[0:h, 0:w]
    total = np.zeros(a.shape)
    for k in range(directions):
        angle = 2 * np.pi * k / directions
        horizon = np.zeros(a.shape)
        for s in range(1, steps + 1):
            d = radius * s / steps
            i = np.clip(np.floor(zz + np.sin(angle) * d / cell + 0.5).astype(int), 0, h - 1)
            j = np.clip(np.floor(xx + np.cos(angle) * d / cell + 0.5).astype(int), 0, w - 1)
            horizon = np.maximum(horizon, (a[i, j] - a) / d)
        total += horizon / np.sqrt(1 + horizon**2)
    return np.clip(1 - intensity * total / directions, 0, 1)


def thermal(a: np.ndarray, cell: float, talus_degrees: float, rounds: int, rate: float = 0.5, erodibility: float = 1.0) -> np.ndarray:
    """Slumping: what exceeds the talus moves to lower neighbours, all cells at once; mass is kept."""
    a, talus = a.copy(), np.tan(np.radians(talus_degrees)) * cell
    h, w = a.shape
    for _ in range(rounds):
        excess = []
        for dx, dz in AROUND:
            e = np.zeros(a.shape)
            zs, xs = slice(max(0, -dz), h - max(0, dz)), slice(max(0, -dx), w - max(0, dx))
            zt, xt = slice(max(0, dz), h + min(0, dz)), slice(max(0, dx), w + min(0, dx))
            e[zs, xs] = np.maximum(0, a[zs, xs] - a[zt, xt] - talus * np.hypot(dx, dz))
            excess.append((e, zs, xs, zt, xt))
        total = sum(e for e, *_ in excess)
        most = np.max([e for e, *_ in excess], axis=0)
        moved = 0.5 * rate * most * erodibility
        delta = -np.where(total > 0, moved, 0)
        for e, zs, xs, zt, xt in excess:
            share = np.divide(e, total, out=np.zeros_like(e), where=total > 0) * moved
            delta[zt, xt] += share[zs, xs]
        a += delta
    return a


LEAST_SIDE, CEILING = 128, {"preview": 384, "final": 768}


def plan_grid(width: int, height: int, world_width: float, feature: float, quality: str = "final") -> tuple[int, int, float]:
    """Width, height and cell size of the grid that a simulation of features of that size runs on."""
    w = math.floor(min(max(world_width / max(feature, 1.0), LEAST_SIDE), CEILING[quality]) + 0.5)
    return w, max(32, math.floor(w * height / width + 0.5)), world_width / w


def _cubic(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices and Catmull-Rom weights (4 each) of samples at ``at``, held at the edges."""
    i = np.floor(at).astype(int)
    t = at - i
    w = np.stack([((2 - t) * t - 1) * t, (3 * t - 5) * t * t + 2, ((4 - 3 * t) * t + 1) * t, (t - 1) * t * t], 1) / 2
    return np.clip(i[:, None] + np.arange(-1, 3), 0, n - 1), w


def resample(a: np.ndarray, width: int, height: int) -> np.ndarray:
    """Box means where either side shrinks, else bicubic at pixel centres."""
    h, w = a.shape
    if (w, h) == (width, height):
        return a.copy()
    if width < w or height < h:
        def means(x: np.ndarray, n: int) -> np.ndarray:
            s = len(x) / n
            low = np.floor(np.arange(n) * s).astype(int)
            high = np.minimum(len(x), np.maximum(low + 1, np.ceil((np.arange(n) + 1) * s).astype(int)))
            total = np.concatenate([np.zeros((1, x.shape[1])), np.cumsum(x, 0)])
            return (total[high] - total[low]) / (high - low)[:, None]

        return means(means(a, height).T, width).T
    (i, u), (j, v) = _cubic((np.arange(height) + 0.5) * h / height - 0.5, h), _cubic((np.arange(width) + 0.5) * w / width - 0.5, w)
    rows = np.einsum("nk,nkw->nw", u, a[i])
    return np.einsum("nk,hnk->hn", v, rows[:, j])


def on_simulation_grid(a: np.ndarray, grid: tuple[int, int, float], simulate: Callable[[np.ndarray, float], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Simulate on ``grid``; only what changed of ``v`` is lifted back, other channels as they are."""
    width, height, cell = grid
    if a.shape == (height, width):
        return simulate(a, cell)
    small = resample(a, width, height)
    out = simulate(small, cell)
    h, w = a.shape
    return {n: a + resample(c - small, w, h) if n == "v" else resample(c, w, h) for n, c in out.items()}


def _sample(a: np.ndarray, x: np.ndarray, z: np.ndarray) -> np.ndarray:
    h, w = a.shape
    x, z = np.clip(x, 0, w - 1), np.clip(z, 0, h - 1)
    i, j = np.floor(x).astype(int), np.floor(z).astype(int)
    p, q, u, v = np.minimum(i + 1, w - 1), np.minimum(j + 1, h - 1), x - i, z - j
    return (a[j, i] + (a[j, p] - a[j, i]) * u) * (1 - v) + (a[q, i] + (a[q, p] - a[q, i]) * u) * v


def pipe_erosion(
    a: np.ndarray, cell: float = 1.0, rounds: int = 200, dt: float = 0.02, rain: float = 0.012, evaporation: float = 0.015, capacity: float = 1.0,
    dissolve: float = 0.3, deposit: float = 0.3, least_slope: float = 0.05, erodibility: np.ndarray | float = 1.0,
) -> dict[str, np.ndarray]:
    """Water in virtual pipes between neighbours (Mei, Decaudin, Hu 2007): v, flow, wear, deposition, water.

    Ground is eroded in row-major order, so a cell sees its west and north neighbours as eroded already:
    cells of one anti-diagonal do not see each other and are done at once.
    """
    ground, (h, w) = a.astype(float), a.shape
    water, mud = np.zeros((h, w)), np.zeros((h, w))
    flux = {side: np.zeros((h, w)) for side in "WENS"}
    flow, wear_, settled = (np.zeros((h, w)) for _ in range(3))
    zz, xx = np.mgrid[0:h, 0:w]
    soft = np.clip(np.broadcast_to(np.asarray(erodibility, float), a.shape), 0, 1)
    diagonals = [np.nonzero(xx + zz == k) for k in range(h + w - 1)]

    def beside(x: np.ndarray, side: str, edge: np.ndarray | float) -> np.ndarray:
        """Each cell's neighbour on that side, ``edge`` where there is none."""
        out = np.empty((h, w))
        out[...] = edge
        to = {"W": (slice(None), slice(1, None)), "E": (slice(None), slice(None, -1)), "N": (slice(1, None), slice(None)), "S": (slice(None, -1), slice(None))}
        source = {"W": (slice(None), slice(None, -1)), "E": (slice(None), slice(1, None)), "N": (slice(None, -1), slice(None)), "S": (slice(1, None), slice(None))}
        out[to[side]] = x[source[side]]
        return out

    for _ in range(rounds):
        water += dt * rain
        level = ground + water
        for side, f in flux.items():
            f[...] = np.maximum(0, f + dt * 9.81 / cell * (level - beside(level, side, level)))
        total, room = sum(flux.values()), water * cell * cell / dt
        scale = np.divide(room, total, out=np.ones((h, w)), where=total > room)
        for f in flux.values():
            f *= scale
        from_w, from_e, from_n, from_s = beside(flux["E"], "W", 0.0), beside(flux["W"], "E", 0.0), beside(flux["S"], "N", 0.0), beside(flux["N"], "S", 0.0)
        before = water
        water = np.maximum(0, before + dt * (from_w + from_e + from_n + from_s - sum(flux.values())) / (cell * cell))
        mean = (before + water) / 2
        speed = lambda x: np.divide(x / 2, cell * mean, out=np.zeros((h, w)), where=mean > 1e-6)
        vx, vz = speed(from_w - flux["W"] + flux["E"] - from_e), speed(from_n - flux["N"] + flux["S"] - from_s)
        flow += np.abs(vx) + np.abs(vz)
        carry = capacity * np.hypot(vx, vz) * np.minimum(1, water * 10)
        for z, x in diagonals:
            gx = (ground[z, np.minimum(x + 1, w - 1)] - ground[z, np.maximum(x - 1, 0)]) / (2 * cell)
            gz = (ground[np.minimum(z + 1, h - 1), x] - ground[np.maximum(z - 1, 0), x]) / (2 * cell)
            slope2 = gx * gx + gz * gz
            gap = np.maximum(least_slope, np.sqrt(slope2 / (1 + slope2))) * carry[z, x] - mud[z, x]
            taken, left = np.where(gap > 0, dissolve * gap * soft[z, x], 0), np.where(gap > 0, 0, -deposit * gap)
            ground[z, x] += left - taken
            mud[z, x] += taken - left
            wear_[z, x] += taken
            settled[z, x] += left
        mud = _sample(mud, xx - vx * dt, zz - vz * dt)
        water = water * max(0.0, 1 - evaporation * dt * 50)
    if flow.max() > 0:  # channels carry thousands of times what hillsides do
        flow = np.log1p(flow) / np.log1p(flow.max())
    return {"v": ground, "flow": flow, "wear": wear_, "deposition": settled, "water": water}
