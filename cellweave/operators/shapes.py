"""Vector layouts on rasters: distance, coverage, values, height edits.

A layout is a parameter of tens of segments, given as Python values; each becomes
an expression, so a layer is one projection without a join.  Layouts of more
than ``MAX_SEGMENTS`` segments are refused; tile the map and clip the layout first.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions.numeric import clamp01, hermite

MAX_SEGMENTS = 512


@dataclass(frozen=True)
class Shape:
    kind: str  # point, polyline or polygon
    points: Sequence[tuple[float, float]]
    closed: bool | None = None
    value: float | None = None
    width: float = 0.0
    falloff: float = 0.0
    id: str = ""
    extra: dict = field(default_factory=dict)

    @property
    def is_closed(self) -> bool:
        return self.kind == "polygon" if self.closed is None else self.closed

    def segments(self) -> list[tuple[float, float, float, float]]:
        p = [(float(x), float(z)) for x, z in self.points]
        if len(p) == 1:
            return [(*p[0], *p[0])]
        pairs = list(zip(p, p[1:])) + ([(p[-1], p[0])] if self.is_closed and len(p) > 2 else [])
        if len(pairs) > MAX_SEGMENTS:
            raise ValueError(f"{len(pairs)} segments; at most {MAX_SEGMENTS} a layout")
        return [(*a, *b) for a, b in pairs]


def segment_distance(px: Column, pz: Column, ax: float, az: float, bx: float, bz: float) -> Column:
    dx, dz = bx - ax, bz - az
    size = dx * dx + dz * dz
    t = clamp01(((px - ax) * dx + (pz - az) * dz) / size) if size else F.lit(0.0)
    return F.hypot(px - (t * dx + ax), pz - (t * dz + az))


def distance(px: Column, pz: Column, shape: Shape) -> Column:
    parts = [segment_distance(px, pz, *s) for s in shape.segments()]
    return parts[0] if len(parts) == 1 else F.least(*parts)


def winding(px: Column, pz: Column, shapes: Sequence[Shape]) -> Column:
    """Winding number of all closed rings together: crossings left of the point."""
    total = F.lit(0)
    for shape in shapes:
        for ax, az, bx, bz in shape.segments() if shape.is_closed and len(shape.points) > 2 else []:
            if az == bz:
                continue
            at = (pz - az) / (bz - az) * (bx - ax) + ax
            low, high = min(az, bz), max(az, bz)
            total = total + F.when((pz >= low) & (pz < high) & (at <= px), F.lit(1 if bz > az else -1)).otherwise(F.lit(0))
    return total


def signed_distance(px: Column, pz: Column, shapes: Sequence[Shape], most: float) -> Column:
    """Distance to the nearest outline, at most ``most``; negative inside (non-zero winding)."""
    near = F.least(*[distance(px, pz, s) for s in shapes], F.lit(float(most)))
    return F.when(winding(px, pz, shapes) != 0, -near).otherwise(near)


def with_coverage(df: DataFrame, px: Column, pz: Column, shapes: Sequence[Shape]) -> DataFrame:
    """``df`` with the coverage of each shape as ``_c0``, ``_c1``, ... (each computed once)."""
    near = df.withColumns({f"_d{i}": reach(px, pz, s) for i, s in enumerate(shapes)})
    return near.withColumns({f"_c{i}": fall(F.col(f"_d{i}"), s) for i, s in enumerate(shapes)}).drop(*[f"_d{i}" for i in range(len(shapes))])


def reach(px: Column, pz: Column, shape: Shape) -> Column:
    """Distance beyond the shape's half width; a polygon's inside has distance 0."""
    d = distance(px, pz, shape)
    d = F.when(winding(px, pz, [shape]) != 0, F.lit(0.0)).otherwise(d) if shape.kind == "polygon" else d
    return d - shape.width / 2


def fall(beyond: Column, shape: Shape, profile: str = "smooth") -> Column:
    fade = F.lit(1.0) - beyond / shape.falloff if shape.falloff > 0 else F.lit(0.0)
    shaped = hermite(fade) if profile == "smooth" else clamp01(fade)
    return F.when(beyond <= 0, F.lit(1.0)).otherwise(shaped)


def coverage(px: Column, pz: Column, shape: Shape, profile: str = "smooth") -> Column:
    """1 inside or within half the width, then falling over ``falloff``."""
    return fall(reach(px, pz, shape), shape, profile)


def rasterise(df: DataFrame, px: Column, pz: Column, shapes: Sequence[Shape]) -> DataFrame:
    """``df`` with ``mask``, the largest coverage, and ``value``.

    ``value`` is the coverage-weighted mean of the shapes' values, faded by the
    strongest coverage.
    """
    rows = with_coverage(df, px, pz, shapes)
    c = [F.col(f"_c{i}") for i in range(len(shapes))]
    weight, total = F.lit(0.0), F.lit(0.0)
    for s, k in zip(shapes, c):
        weight, total = weight + k, total + k * (s.value or 0.0)
    strongest = c[0] if len(c) == 1 else F.greatest(*c)
    return rows.withColumns({"mask": strongest, "value": F.when(weight > 0, F.try_divide(total, weight) * strongest).otherwise(F.lit(0.0))})


def apply_to_height(df: DataFrame, px: Column, pz: Column, shapes: Sequence[Shape], mode: str = "set", strength: float = 1.0, v: str = "v") -> DataFrame:
    """Shapes edit the height in list order; each sees the result of those before.

    A shape without a value takes the mean height where its coverage is at least one half.
    """
    df = with_coverage(df, px, pz, shapes)
    for n, s in enumerate(shapes):
        name = f"_c{n}"
        if s.value is None and mode != "add":
            one = df.agg(F.coalesce(F.avg(F.when(F.col(name) >= 0.5, F.col(v))), F.lit(0.0)).alias("_mean"))
            df, goal = df.join(F.broadcast(one)), F.col("_mean")
        else:
            goal = F.lit(float(s.value or 0.0))
        new = {"set": goal, "add": F.col(v) + goal, "max": F.greatest(F.col(v), goal), "min": F.least(F.col(v), goal)}[mode]
        df = df.withColumn(v, F.col(v) + (new - F.col(v)) * F.col(name) * strength).drop(name, "_mean")
    return df


def cross_section(u: Column, profile: str) -> Column:
    a = F.abs(u)
    t = {
        "parabolic": lambda: F.lit(1.0) - a * a, "v": lambda: F.lit(1.0) - a,
        "trapezoid": lambda: F.least(F.lit(1.0), (F.lit(1.0) - a) * 2), "smooth": lambda: hermite(F.lit(1.0) - a),
    }[profile]()
    return F.when(a >= 1, F.lit(0.0)).otherwise(t)


def stations(points: Sequence[tuple[float, float]], spacing: float, closed: bool = False) -> list[tuple[float, float, float]]:
    """(x, z, arc length) along a polyline, no further apart than ``spacing``."""
    p = [*points, points[0]] if closed else list(points)
    out, arc = [(float(p[0][0]), float(p[0][1]), 0.0)], 0.0
    for (ax, az), (bx, bz) in zip(p, p[1:]):
        size = math.hypot(bx - ax, bz - az)
        n = max(1, math.ceil(size / spacing))
        out += [(ax + (bx - ax) * i / n, az + (bz - az) * i / n, arc + size * i / n) for i in range(1, n + 1)]
        arc += size
    return out


def falling_bed(ground: Sequence[float], arcs: Sequence[float], depth: float, least_slope: float = 1 / 400, start: float | None = None, end: float | None = None) -> list[float]:
    """Bed heights along stations: ``depth`` below the ground, then held to fall by at least ``least_slope``.

    With both ends given the bed is graded between them before it is held.
    """
    last = len(arcs) - 1
    if start is not None and end is not None:
        bed = [start + (end - start) * (a / arcs[-1] if arcs[-1] > 0 else 0.0) for a in arcs]
    else:
        bed = [g - depth for g in ground]
        bed[0] = bed[0] if start is None else start
        bed[last] = bed[last] if end is None else min(end, bed[last])
    for i in range(1, len(bed)):
        bed[i] = min(bed[i], bed[i - 1] - least_slope * (arcs[i] - arcs[i - 1]))
    return bed


def carve(
    df: DataFrame, px: Column, pz: Column, along: Sequence[tuple[float, float, float]], bed: Sequence[float], width: float = 64.0, depth: float = 20.0,
    bank: float | None = None, profile: str = "parabolic", v: str = "v",
) -> DataFrame:
    """Cut a channel (never fill) along stations (x, z, arc) with bed heights; and ``channel``, what was cut by the depth."""
    half = max(8.0, width) / 2
    flare = max(0.0, half if bank is None else bank)
    best = None
    for (ax, az, _), (bx, bz, _), low, high in zip(along, along[1:], bed, bed[1:]):
        dx, dz = bx - ax, bz - az
        size = dx * dx + dz * dz
        t = clamp01(((px - ax) * dx + (pz - az) * dz) / size) if size else F.lit(0.0)
        one = F.struct(F.hypot(px - (t * dx + ax), pz - (t * dz + az)).alias("d"), (t * (high - low) + low).alias("bed"))
        best = one if best is None else F.least(best, one)
    near = df.withColumn("_near", best)
    d, floor = F.col("_near")["d"], F.col("_near")["bed"]
    surface = floor + depth - cross_section(F.least(d / half, F.lit(1.0)), profile) * depth
    outside = hermite(F.lit(1.0) - (d - half) / flare) if flare > 0 else F.lit(0.0)
    blend = F.when(d <= half, F.lit(1.0)).otherwise(outside)
    new = F.col(v) + (F.least(F.col(v), surface) - F.col(v)) * blend
    cut = clamp01((F.col(v) - F.col("_new")) / max(depth, 1e-9))
    return near.withColumn("_new", new).withColumn("channel", cut).withColumn(v, F.col("_new")).drop("_near", "_new")


def river(grid, shape: Shape, spacing: float, **how) -> DataFrame:
    """Carve ``shape`` into ``grid``: stations are sampled from the raster (a few hundred points), the bed made on the driver."""
    from cellweave.operators.stencil import bilinear

    cell = grid.meta.cell
    along = stations(shape.points, spacing)
    spark = grid.df.sparkSession
    at = spark.createDataFrame([(i, x / cell, z / cell) for i, (x, z, _) in enumerate(along)], "i int, sx double, sz double")
    ground = [r["v"] for r in bilinear(grid, at).orderBy("i").collect()]
    keys = {k: how.pop(k) for k in ("least_slope", "start", "end") if k in how}
    bed = falling_bed(ground, [a for _, _, a in along], how.get("depth", 20.0), **keys)
    return carve(grid.df, F.col("x") * cell, F.col("z") * cell, along, bed, **how)


def bounds(points: Sequence[tuple[float, float]]) -> tuple[float, float, float, float]:
    """Least x and z, greatest x and z."""
    xs, zs = zip(*points)
    return min(xs), min(zs), max(xs), max(zs)


def spline(points: Sequence[tuple[float, float]], t: float, closed: bool = False) -> tuple[float, float]:
    """A point of the centripetal Catmull-Rom curve through ``points``, t in 0..1."""
    n = len(points)
    if n < 2:
        return tuple(map(float, points[0]))
    pieces = n if closed else n - 1
    place = min(max(t, 0.0), 1.0) * pieces
    i = min(int(place), pieces - 1)
    u = place - i

    def point(k: int) -> tuple[float, float]:
        if closed:
            return points[k % n]
        if k < 0:  # mirrored beyond the ends
            return 2 * points[0][0] - points[1][0], 2 * points[0][1] - points[1][1]
        return points[k] if k < n else (2 * points[-1][0] - points[-2][0], 2 * points[-1][1] - points[-2][1])

    p = [point(i + k) for k in (-1, 0, 1, 2)]
    knots = [0.0]
    for (ax, az), (bx, bz) in zip(p, p[1:]):
        knots.append(knots[-1] + max(math.hypot(bx - ax, bz - az) ** 0.5, 1e-9))
    at = knots[1] + u * (knots[2] - knots[1])
    level = p
    for size in (1, 2, 3):  # Barry and Goldman's pyramid
        low = [max(0, k) if size == 3 else k for k in range(len(level) - 1)]
        span = {1: [(0, 1), (1, 2), (2, 3)], 2: [(0, 2), (1, 3)], 3: [(1, 2)]}[size]
        level = [
            tuple(((knots[b] - at) * c + (at - knots[a]) * d) / (knots[b] - knots[a]) for c, d in zip(level[k], level[k + 1])) for k, (a, b) in zip(low, span)
        ]
    return level[0]


#: Sides of a pad are multiples of this, and one such at least.
PAD_STEP = 16.0


def pad(cx: float, cz: float, width: float, depth: float, rotation: float = 0.0, value: float | None = None, falloff: float = 0.0, id: str = "pad") -> Shape:
    """A rectangle about a middle, its sides rounded up to whole steps."""
    w, d = (max(PAD_STEP, math.ceil(s / PAD_STEP - 1e-9) * PAD_STEP) / 2 for s in (width, depth))
    co, si = math.cos(rotation), math.sin(rotation)
    ring = [(cx + x * co - z * si, cz + x * si + z * co) for x, z in ((-w, -d), (w, -d), (w, d), (-w, d))]
    return Shape("polygon", ring, True, value, 0.0, falloff, id)


KINDS = ("point", "polyline", "polygon")


def parse(text: str) -> list[Shape]:
    """Shapes of a JSON document: a list, or an object with ``shapes``; points as {x, z}."""
    found = json.loads(text) if text.strip() else []
    rows = found.get("shapes", []) if isinstance(found, dict) else found
    out = []
    for n, s in enumerate(rows):
        if s.get("kind") not in KINDS:
            raise ValueError(f"shape {n} has the unknown kind {s.get('kind')}")
        points = [(float(p["x"]), float(p["z"])) for p in s["points"]]
        out.append(Shape(s["kind"], points, s.get("closed"), s.get("value"), float(s.get("width") or 0), float(s.get("falloff") or 0), str(s.get("id", f"shape-{n}"))))
    return out


def serialise(shapes: Sequence[Shape]) -> str:
    rows = []
    for s in shapes:
        row = {"id": s.id, "kind": s.kind, "points": [{"x": x, "z": z} for x, z in s.points], "closed": s.closed, "value": s.value, "width": s.width, "falloff": s.falloff}
        rows.append({k: v for k, v in row.items() if v is not None})
    return json.dumps(rows)


def select(shapes: Sequence[Shape], text: str = "") -> list[Shape]:
    """Shapes whose id holds ``text``, whatever its case; all for an empty text."""
    return [s for s in shapes if text.lower() in s.id.lower()]
