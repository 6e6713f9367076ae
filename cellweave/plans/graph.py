"""Typed operator graphs compiled on the driver into lazy rasters.

Nodes are pulled from an output; inputs come first, a content hash of type,
parameters and input hashes keys the memo, so unchanged subgraphs give the same
lazy plan.  Nothing runs until an action on the result.
"""

from __future__ import annotations

import hashlib
import json
from collections import OrderedDict
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cellweave.functions.numeric import clamp01
from cellweave.functions.seeds import derive_seed, signed32
from cellweave.operators import kernels, pointwise, shapes, stencil, symmetry
from cellweave.operators.grid import Grid, GridMeta, blank
from cellweave.operators.noise import Noise, fractal


class GraphError(ValueError):
    """A graph that cannot be evaluated; the message names the node."""


@dataclass(frozen=True)
class Param:
    default: object
    low: float | None = None
    high: float | None = None
    options: tuple = ()

    def normal(self, value: object) -> object:
        """Missing gives the default, numbers are held in range, unknown options give the default."""
        if value is None:
            return self.default
        if self.options:
            return value if value in self.options else self.default
        if isinstance(self.default, bool):
            return bool(value)
        if isinstance(self.default, (int, float)):
            try:
                number = float(value)
            except (TypeError, ValueError):
                return self.default
            number = max(number, self.low) if self.low is not None else number
            number = min(number, self.high) if self.high is not None else number
            return int(number + 0.5) if isinstance(self.default, int) else number
        return value


@dataclass(frozen=True)
class Node:
    inputs: tuple[str, ...]
    params: dict[str, Param]
    run: Callable
    optional: tuple[str, ...] = ()


def _same(grid: Grid, value) -> Grid:
    return replace(grid, df=grid.df.select("x", "z", value.alias("v")))


def _ranged(grid: Grid, value: Callable) -> Grid:
    rows = pointwise.ranged(grid.df)
    return replace(grid, df=rows.select("x", "z", value(F.col("v"), F.col("lo"), F.col("hi")).alias("v")))


def _gradient(e: "Evaluator", p: dict) -> Grid:
    u = F.col("x") / float(max(1, e.meta.width - 1))
    w = F.col("z") / float(max(1, e.meta.height - 1))
    return blank(e.spark, e.meta, pointwise.ramp(u, w, p["direction"], p["falloff"], low=p["low"], high=p["high"]))


def _noise(e: "Evaluator", p: dict) -> Grid:
    made = Noise(p["fractal"], p["basis"], p["frequency"], p["octaves"], seed=signed32(p["seed"] + p["_derived"]))
    return blank(e.spark, e.meta, fractal(F.col("x") / float(e.meta.width), F.col("z") / float(e.meta.width), made) * p["amplitude"] + p["offset"])


def _masked(e: "Evaluator", before: Grid, after: Grid, mask: Grid | None) -> Grid:
    if mask is None or (mask.meta.width, mask.meta.height) != (before.meta.width, before.meta.height):
        return after  # a mask of another size is left out
    rows = before.zip(after, "_a").zip(mask, "_m")
    return _same(rows, pointwise.masked(F.col("v"), F.col("_a"), F.col("_m")))


def _combine(e: "Evaluator", p: dict, a: Grid, b: Grid, mask: Grid | None = None) -> Grid:
    out = _same(a.zip(b, "b"), pointwise.combine(F.col("v"), F.col("b"), p["mode"], p["factor"]))
    return _masked(e, a, out, mask)


def _warp(e: "Evaluator", p: dict, t: Grid, by: Grid, mask: Grid | None = None) -> Grid:
    both = t.zip(by, "_by")
    return _masked(e, t, replace(t, df=stencil.warp(both, "_by", p["amount"] / t.meta.world_width * t.meta.width)), mask)


def _simulated(t: Grid, kernel: Callable) -> Grid:
    """``kernel`` on the whole raster, in one task."""
    out = kernels.on_grid(t.df.select(F.lit(0).alias("map_id"), "x", "z", "v"), kernel, ["v"])
    return replace(t, df=out.drop("map_id"))


def _open(e: "Evaluator", p: dict, t: Grid) -> Grid:
    cell, steps = t.meta.cell, (6, 8) if e.quality == "preview" else (12, 16)
    return _simulated(t, lambda a: {"v": kernels.ambient_occlusion(a, cell, p["radius"], *steps, p["intensity"])})


#: Fixed value: material moves so many world units for each unit of amount, a cell a round.
TRAVEL, TALUS_STEPS = 400.0, 24


def _thermal(e: "Evaluator", p: dict, t: Grid, mask: Grid | None = None) -> Grid:
    far, (w, h) = max(40.0, p["amount"] * TRAVEL), (t.meta.width, t.meta.height)
    grid = kernels.plan_grid(w, h, t.meta.world_width, far / TALUS_STEPS, e.quality)
    rounds = max(4, min(96, int(far / grid[2] + 0.5)))
    return _masked(e, t, _simulated(t, lambda a: kernels.on_simulation_grid(a, grid, lambda s, cell: {"v": kernels.thermal(s, cell, p["angle"], rounds)})), mask)


def _layout(e: "Evaluator", p: dict, run: Callable) -> Grid:
    found, grid = shapes.select(shapes.parse(p["shapes"]), p["only"]), blank(e.spark, e.meta)
    at = F.col("x") * e.meta.cell, F.col("z") * e.meta.cell
    return _same(replace(grid, df=run(grid.df, at, found)), F.col("v")) if found else grid


def _symmetric(e: "Evaluator", p: dict, t: Grid) -> Grid:
    if not symmetry.applicable(p["kind"], t.meta.width, t.meta.height):
        raise GraphError(f"{p['kind']} does not fit a raster of {t.meta.width} by {t.meta.height}")
    return replace(t, df=symmetry.enforce(t, p["kind"], p["mode"], p["strength"]))


def blank_like(e: "Evaluator", t: Grid, measure: str) -> Grid:
    """A statistic of ``t`` on every cell."""
    one = pointwise.statistics(t.df).select(F.col(measure).alias("_one"))
    return replace(t, df=t.df.join(F.broadcast(one)).select("x", "z", F.col("_one").alias("v")))


BLEND = tuple(pointwise.BLENDS)
REGISTRY: dict[str, Node] = {
    "generator.constant": Node((), {"value": Param(0.0)}, lambda e, p: blank(e.spark, e.meta, p["value"])),
    "generator.gradient": Node((), {"direction": Param("radial", options=("radial", "box", "x", "z", "diagonal")), "falloff": Param("smooth", options=("linear", "smooth", "sharp")), "low": Param(0.0), "high": Param(1.0)}, _gradient),
    "generator.noise": Node((), {"fractal": Param("fbm", options=("fbm", "ridged", "billow", "hybrid", "multiply")), "basis": Param("perlin", options=("perlin", "simplex", "value", "worley")), "frequency": Param(4.0, 0.01), "octaves": Param(4, 1, 14), "amplitude": Param(1.0), "offset": Param(0.0), "seed": Param(1)}, _noise),
    "filter.clamp": Node(("terrain", "mask"), {"min": Param(-200.0), "max": Param(800.0), "softness": Param(0.0, 0, 500)}, lambda e, p, t, m=None: _masked(e, t, _same(t, pointwise.clamp_soft(F.col("v"), p["min"], p["max"], p["softness"])), m), ("mask",)),
    "filter.terrace": Node(("terrain", "mask"), {"steps": Param(6, 1, 64), "sharpness": Param(0.5, 0, 1)}, lambda e, p, t, m=None: _masked(e, t, _ranged(t, lambda v, lo, hi: pointwise.terrace(v, p["steps"], p["sharpness"], lo, hi)), m), ("mask",)),
    "filter.remap": Node(("terrain", "mask"), {"outLow": Param(0.0), "outHigh": Param(1.0)}, lambda e, p, t, m=None: _masked(e, t, _ranged(t, lambda v, lo, hi: pointwise.remap(v, lo, hi, p["outLow"], p["outHigh"])), m), ("mask",)),
    "filter.smooth": Node(("terrain", "mask"), {"radius": Param(32.0, 0)}, lambda e, p, t, m=None: _masked(e, t, stencil.gaussian_blur(t, p["radius"] / t.meta.world_width * t.meta.width / 3), m), ("mask",)),
    "filter.sharpen": Node(("terrain", "mask"), {"radius": Param(32.0, 0), "amount": Param(0.5, 0)}, lambda e, p, t, m=None: _masked(e, t, _same(stencil.unsharp(t, p["radius"] / t.meta.world_width * t.meta.width / 3, p["amount"]), F.col("v")), m), ("mask",)),
    "filter.seaLevel": Node(("terrain",), {"coverage": Param(0.2, 0, 0.95)}, lambda e, p, t: replace(t, df=pointwise.sea_level(t.df, p["coverage"]).select("x", "z", "v"))),
    "filter.flatten": Node(("terrain",), {"mode": Param("average", options=("average", "lowest", "highest", "fixed")), "target": Param(0.0), "strength": Param(1.0, 0, 1)}, lambda e, p, t: replace(t, df=pointwise.flatten(t.df, p["mode"], p["strength"], p["target"]))),
    "filter.transform": Node(("terrain",), {"offsetX": Param(0.0), "offsetZ": Param(0.0), "scale": Param(1.0, 0.01), "rotation": Param(0.0)}, lambda e, p, t: replace(t, df=stencil.transform(t, p["offsetX"], p["offsetZ"], p["scale"], p["rotation"]))),
    "filter.curve": Node(("terrain", "mask"), {"points": Param(((0.0, 0.0), (1.0, 1.0)))}, lambda e, p, t, m=None: _masked(e, t, _ranged(t, lambda v, lo, hi: pointwise.apply_curve(v, [tuple(q) for q in p["points"]], lo, hi)), m), ("mask",)),
    "filter.warp": Node(("terrain", "warp", "mask"), {"amount": Param(100.0)}, _warp, ("mask",)),
    "selector.curvature": Node(("terrain",), {"kind": Param("convex", options=("convex", "concave")), "strength": Param(1.0, 0.05, 20), "invert": Param(False)}, lambda e, p, t: _select(stencil.curvature(t), clamp01(F.lit(0.5) + F.col("profile") * (p["strength"] * t.meta.cell * (40 if p["kind"] == "convex" else -40))), p)),
    "selector.flow": Node(("terrain",), {"threshold": Param(0.6, 0, 1), "falloff": Param(0.15, 0, 1), "dinf": Param(True), "invert": Param(False)}, lambda e, p, t: _select(_simulated(t, lambda a: {"v": kernels.flow_accumulation(a, p["dinf"])}), pointwise.band_mask(F.col("v"), p["threshold"], 2.0, p["falloff"]), p)),
    "selector.occlusion": Node(("terrain",), {"radius": Param(512.0, 16, 8192), "intensity": Param(1.0, 0, 3), "invert": Param(False)}, lambda e, p, t: _select(_open(e, p, t), F.lit(1.0) - F.col("v"), p)),
    "natural.thermal": Node(("terrain", "mask"), {"angle": Param(35.0, 5, 80), "amount": Param(1.0, 0.05, 5)}, _thermal, ("mask",)),
    "natural.snow": Node(("terrain", "mask"), {"line": Param(400.0, -10000, 10000), "slopeLimit": Param(45.0, 10, 85), "thickness": Param(8.0, 0, 200), "settle": Param(0.5, 0, 1)}, lambda e, p, t, m=None: _masked(e, t, _same(stencil.snow(t, p["line"], p["slopeLimit"], p["thickness"], p["settle"]), F.col("v")), m), ("mask",)),
    "layout.mask": Node((), {"shapes": Param(""), "only": Param(""), "invert": Param(False)}, lambda e, p: _layout(e, p, lambda rows, at, found: shapes.rasterise(rows, *at, found).withColumn("v", F.lit(1.0) - F.col("mask") if p["invert"] else F.col("mask")))),
    "layout.distance": Node((), {"shapes": Param(""), "only": Param(""), "maxDistance": Param(1024.0, 0), "grow": Param(0.0)}, lambda e, p: _layout(e, p, lambda rows, at, found: rows.withColumn("v", shapes.signed_distance(*at, found, p["maxDistance"]) - p["grow"]))),
    "gameplay.symmetry": Node(("terrain",), {"kind": Param("rotate180", options=tuple(symmetry.ELEMENTS)), "mode": Param("average", options=("average", "source", "last", "max", "min")), "strength": Param(1.0, 0, 1)}, _symmetric),
    "utility.statistics": Node(("in",), {"measure": Param("mean", options=("min", "max", "mean", "range"))}, lambda e, p, t: blank_like(e, t, p["measure"])),
    "utility.number": Node((), {"value": Param(0.0)}, lambda e, p: blank(e.spark, e.meta, p["value"])),
    "combiner.combine": Node(("a", "b", "mask"), {"mode": Param("add", options=BLEND), "factor": Param(1.0, -4, 4)}, _combine, ("mask",)),
    "combiner.blend": Node(("a", "b"), {"amount": Param(0.5, 0, 1)}, lambda e, p, a, b: _same(a.zip(b, "b"), pointwise.masked(F.col("v"), F.col("b"), p["amount"]))),
    "combiner.heightSplit": Node(("a", "b"), {"height": Param(200.0), "softness": Param(60.0, 0, 2000)}, lambda e, p, a, b: _same(a.zip(b, "b"), pointwise.height_split(F.col("v"), F.col("b"), p["height"], p["softness"])[0])),
    "selector.height": Node(("terrain",), {"low": Param(0.0), "high": Param(100.0), "falloff": Param(10.0, 0), "invert": Param(False)}, lambda e, p, t: _select(t, pointwise.band_mask(F.col("v"), p["low"], p["high"], p["falloff"]), p)),
    "selector.slope": Node(("terrain",), {"low": Param(0.0), "high": Param(27.0), "falloff": Param(5.0, 0), "invert": Param(False)}, lambda e, p, t: _select(stencil.gradient(t), pointwise.band_mask(stencil.slope_degrees(), p["low"], p["high"], p["falloff"]), p)),
    "utility.math": Node(("in",), {"operation": Param("multiply", options=("multiply", "add", "power", "abs", "negate", "oneMinus", "floor", "step")), "operand": Param(1.0, -1000, 1000)}, lambda e, p, t: _same(t, pointwise.math(F.col("v"), p["operation"], p["operand"]))),
    "utility.reroute": Node(("in",), {}, lambda e, p, t: t),
    "output.height": Node(("terrain",), {"waterLevel": Param(0.0)}, lambda e, p, t: _same(t, F.col("v") - p["waterLevel"])),
    "output.metal": Node(("metal",), {"scale": Param(1.0, 0), "threshold": Param(0.0, 0, 1)}, lambda e, p, t: _same(t, pointwise.output_metal(F.col("v"), p["scale"], p["threshold"]))),
    "output.terrainType": Node(("type",), {"mode": Param("index", options=("index", "mask"))}, lambda e, p, t: _same(t, pointwise.output_terrain_type(F.col("v"), p["mode"]))),
    "output.grass": Node(("in",), {"strength": Param(1.0, 0)}, lambda e, p, t: _same(t, F.col("v") * p["strength"])),
}


def _select(grid: Grid, mask, p: dict) -> Grid:
    return _same(grid, F.lit(1.0) - mask if p["invert"] else mask)


class Evaluator:
    """Pulls rasters from a graph (``nodes``, ``edges``) with a memo by content."""

    def __init__(self, spark: SparkSession, graph: dict | str, meta: GridMeta, seed: int = 0, quality: str = "final", budget: int = 512 << 20) -> None:
        graph = json.loads(graph) if isinstance(graph, str) else graph
        self.spark, self.meta, self.memo, self.misses = spark, meta, OrderedDict(), 0
        self.seed, self.quality, self.budget, self.graph = seed, quality, budget, graph
        self.nodes: dict[str, dict] = {}
        self.sources: dict[tuple[str, str], str] = {}
        for n in graph["nodes"]:
            if n["id"] in self.nodes:
                raise GraphError(f"two nodes have the id {n['id']}")
            if n["type"] not in REGISTRY:
                raise GraphError(f"node {n['id']} has the unknown type {n['type']}")
            self.nodes[n["id"]] = n
        for e in graph["edges"]:
            if e["fromNode"] not in self.nodes or e["toNode"] not in self.nodes:
                raise GraphError(f"an edge names a missing node: {e}")
            if (e["toNode"], e["toPort"]) in self.sources:
                raise GraphError(f"two edges reach {e['toNode']}.{e['toPort']}")
            self.sources[e["toNode"], e["toPort"]] = e["fromNode"]

    def evaluate(self, node_id: str) -> Grid:
        return self._pull(node_id, ())[1]

    def evaluate_many(self, node_ids: Sequence[str]) -> dict[str, Grid]:
        """Several nodes; what they share is planned once."""
        return {n: self.evaluate(n) for n in node_ids}

    def _keep(self, key: str, grid: Grid) -> None:
        """Holds plans up to the budget (8 bytes a sample); the oldest go first, down to four fifths of it."""
        self.memo[key] = grid
        cost = lambda g: 8 * g.meta.width * g.meta.height
        total = sum(map(cost, self.memo.values()))
        if total > self.budget:
            while len(self.memo) > 1 and total > self.budget * 0.8:
                total -= cost(self.memo.popitem(last=False)[1])

    def _pull(self, node_id: str, above: tuple[str, ...]) -> tuple[str, Grid]:
        if node_id in above:
            raise GraphError(f"a cycle runs through {node_id}")
        node = self.nodes[node_id]
        kind = REGISTRY[node["type"]]
        found = {p: self._pull(self.sources[node_id, p], (*above, node_id)) for p in kind.inputs if (node_id, p) in self.sources}
        if node.get("bypassed") and found:
            return next(iter(found.values()))
        for port in kind.inputs:
            if port not in found and port not in kind.optional:
                raise GraphError(f"node {node_id} has nothing at {port}")
        given = node.get("params") or {}
        params = {k: p.normal(given.get(k)) for k, p in kind.params.items()}
        if "seed" in params:
            params["_derived"] = derive_seed(self.seed, node_id)
        key = hashlib.sha256(json.dumps([node["type"], params, {p: k for p, (k, _) in found.items()}, [self.meta.width, self.meta.height, self.meta.cell]], sort_keys=True).encode()).hexdigest()
        if key in self.memo:
            self.memo.move_to_end(key)
            return key, self.memo[key]
        self.misses += 1
        out = kind.run(self, params, *[found[p][1] if p in found else None for p in kind.inputs])
        self._keep(key, out)
        return key, out


def descendants(graph: dict, node_id: str) -> set[str]:
    """The nodes that a change of ``node_id`` touches, itself included."""
    out, todo = {node_id}, [node_id]
    while todo:
        here = todo.pop()
        new = {e["toNode"] for e in graph["edges"] if e["fromNode"] == here} - out
        out |= new
        todo += new
    return out


def topological_order(graph: dict) -> tuple[list[str], list[str]]:
    """Node ids, inputs first (in document order where free), and the nodes that a cycle leaves over."""
    waiting = {n["id"]: sum(e["toNode"] == n["id"] for e in graph["edges"]) for n in graph["nodes"]}
    ready, order = [n for n, count in waiting.items() if not count], []
    for node in ready:  # grows as inputs are met
        order.append(node)
        for e in graph["edges"]:
            if e["fromNode"] == node:
                waiting[e["toNode"]] -= 1
                if not waiting[e["toNode"]]:
                    ready.append(e["toNode"])
    return order, [n for n in waiting if n not in order]
