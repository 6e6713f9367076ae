"""Embedding near-duplicates by NN-descent.

0. Equal vectors are one node with a weight.
1. Start: vectors are sorted by (signs of random projections, one more
   projection), and overlapping runs of ``RUN`` neighbours in that order are
   compared; a few such orders give every vector its first neighbour list.
2. Descent: every vector is a centre; its neighbours and the vectors that have
   it as neighbour are compared with each other, and what is nearer than a
   list's last entry enters.  Long reverse lists are dealt out in chunks, anew
   each round, with the centre in every chunk.
3. Lists hold ``k`` entries; a list that is saturated (all entries above the
   threshold) is enlarged up to ``k_large``.  Groups that fill lists with their own
   members are thinned to ``REPS`` members each, others every pass.  A pass thins,
   descends and brings in new random orders; passes go on until one joins nothing.
4. Every comparison that reaches the threshold gives links, as spanning links of
   the compared group, so no pairs of a large group are listed.
5. Components of the links; inside each component the number of links of every
   vector is counted exactly, in double precision, by pairs of blocks.
6. Audit: the links of a sample that grows with the table are counted against
   all rows.  Recall is averaged over vectors, so no large group hides others, in
   each of three strata: vectors without a component, in small components, in
   large ones.  Below ``target`` in any, more passes are run, and at last an
   exact comparison by pairs of blocks joins what the search has missed.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; vectors of different lengths never link; equal
vectors link; rows of one identifier are separate vectors; the smallest
identifier of a component ignores nulls; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.llm.common import cut, remove, scratch
from cellweave.llm.components import components, label_rows

K, K_LARGE = 8, 32
#: Runs of an order; they overlap by half.
RUN = 64
ORDERS = 4
#: Passes end when one joins nothing; this only bounds them.
ROUNDS = 30
SIGNS = 8
#: Rows of a block of the exact comparisons; a tile holds two blocks.
BLOCK = 512
#: Rows that a task sorts for an order, at least.
ORDER_ROWS = 2048
AUDIT_ROWS = 256
#: Components of more vectors than this are large ones for the audit.
LARGE = 32
TARGET = 0.999
MAX_EXTRA = 2
SEED = 11
#: Members of a thinned group: fewer than half a list, so that lists look out of the group.
REPS = 4
SALTS = 64


def unit_vectors(frame: DataFrame) -> DataFrame:
    """node, vec_id, dim, vec (packed doubles of length 1; null if it links with nothing)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, dims = [], []
            for v in batch.column(2).to_pylist():
                x = np.array(v, np.float64) if v and None not in v else np.zeros(0)
                size = 0.0
                if x.size and np.isfinite(x).all():
                    top = np.abs(x).max()
                    x = x / top + 0.0 if top else x  # no overflow of squares, no negative zeros
                    size = np.sqrt(x @ x)
                out.append((x / size).tobytes() if size > 0 else None)
                dims.append(len(x) if size > 0 else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], names=["node", "vec_id", "dim", "vec"])

    kind = frame.schema["vec_id"].dataType.simpleString()
    return frame.select(F.monotonically_increasing_id().alias("node"), "vec_id", "embedding").mapInArrow(
        run, f"node long, vec_id {kind}, dim int, vec binary"
    )


def group_links(sims: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the pairs at ``threshold`` or more (positions)."""
    near = sims >= threshold
    np.fill_diagonal(near, True)
    label, n = np.arange(len(near)), len(near)
    while True:
        new = np.where(near, label, n).min(1)
        if (new == label).all():
            break
        label = new
    # A label is reached over links, but need not be linked directly: the components of the group are what counts.
    at = np.flatnonzero(label != np.arange(n))
    return at, label[at]


def compare(nodes: np.ndarray, x: np.ndarray, worst: np.ndarray, threshold: float, k: int) -> list[np.ndarray]:
    """Candidates (node, other, sim) better than ``worst``, at most ``k`` a node; spanning links (node, other)."""
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    none = np.zeros(0, np.int64)
    i, j = group_links(sims.copy(), threshold) if (sims >= threshold).any() else (none, none)
    if len(nodes) - 1 > k:
        cols = np.argpartition(-sims, k - 1, axis=1)[:, :k].ravel()
        rows = np.repeat(np.arange(len(nodes)), k)
    else:
        rows, cols = np.nonzero(sims > -2)
    value = sims[rows, cols]
    good = value > worst[rows]
    return [nodes[rows[good]], nodes[cols[good]], value[good], nodes[i], nodes[j]]


SCHEMA = pa.schema([("kind", pa.int8()), ("n", pa.int64()), ("m", pa.int64()), ("s", pa.float64())])


def _emit(found: list[list[np.ndarray]]) -> pa.RecordBatch:
    n, m, s, a, b = (np.concatenate(c) for c in zip(*found))
    kind = np.repeat(np.array([0, 1], np.int8), [len(n), len(a)])
    columns = [kind, np.concatenate([n, a]), np.concatenate([m, b]), np.concatenate([s, np.ones(len(a))])]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEMA)], schema=SCHEMA)


def _runs(batches: Iterator[pa.RecordBatch], keys: int, limit: int | None) -> Iterator[list[tuple]]:
    """Groups of rows that agree on the first ``keys`` columns.

    With a ``limit``, longer groups come as windows of so many rows that overlap by half.
    """
    held, last, fresh = [], None, 0
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            key = row[:keys]
            if key != last:
                if fresh:
                    yield held
                held, fresh = [], 0
            elif limit and len(held) >= limit:
                yield held
                held, fresh = held[limit // 2 :], 0
            held.append(row)
            fresh += 1
            last = key
    if fresh:
        yield held


def _local(threshold: float, k: int, limit: int | None) -> Callable:
    """Compare inside groups of sorted rows (dim, key, chunk, node, worst, vec)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for group in _runs(batches, 3, limit):
            by = {r[3]: r for r in group}  # a node may come by two ways
            if len(by) < 2:
                continue
            rows = list(by.values())
            x = np.frombuffer(b"".join([r[5] for r in rows])).reshape(len(rows), -1)
            found.append(compare(np.array([r[3] for r in rows]), x, np.array([r[4] for r in rows]), threshold, k))
            size += len(found[-1][0])
            if size > 50_000:
                yield _emit(found)
                found, size = [], 0
        if found:
            yield _emit(found)

    return run


def _order(vectors: DataFrame, number: int, parts: int, threshold: float, k: int) -> DataFrame:
    """Comparisons along one random order: overlapping runs of neighbours."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        bit = 1 << np.arange(SIGNS)
        for batch in batches:
            dims, vecs = batch.column(0).to_numpy(), batch.column(2).to_pylist()
            keys, places = np.zeros(len(dims), np.int64), np.zeros(len(dims))
            for dim in np.unique(dims).tolist():
                if dim not in planes:
                    planes[dim] = np.random.default_rng([SEED, number, dim]).standard_normal((SIGNS + 1, dim))
                at = np.flatnonzero(dims == dim)
                p = np.frombuffer(b"".join([vecs[i] for i in at])).reshape(len(at), dim) @ planes[dim].T
                keys[at], places[at] = (p[:, :SIGNS] > 0) @ bit, p[:, SIGNS]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys), pa.array(places)], names=["dim", "node", "vec", "key", "place"])

    dealt = vectors.select("dim", "node", "vec").mapInArrow(project, "dim int, node long, vec binary, key long, place double")
    tie = F.xxhash64("node", F.lit(number))  # equal places are cut elsewhere in each order
    dealt = dealt.withColumn("tie", tie).repartitionByRange(parts, "dim", "key", "place", "tie").sortWithinPartitions("dim", "key", "place", "tie")
    # One key of equal zeros: runs go on over the borders of sign cells.
    return dealt.select("dim", F.lit(0).alias("k"), F.lit(0).alias("c"), "node", F.lit(-2.0).alias("worst"), "vec").mapInArrow(
        _local(threshold, k, RUN), "kind byte, n long, m long, s double"
    )


def _best(cands: DataFrame, threshold: float, k: int, k_large: int) -> DataFrame:
    """Neighbour lists: the ``k`` nearest, and as many as ``k_large`` above the threshold."""
    rank = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("s"), "m"))
    unique = cands.groupBy("n", "m").agg(F.max("s").alias("s"))
    return unique.withColumn("r", rank).where(F.col("r") <= k_large).where((F.col("r") <= k) | (F.col("s") >= threshold))


def _descend(vectors: DataFrame, lists: DataFrame, threshold: float, k: int, number: int = 0) -> DataFrame:
    """One round of neighbours-of-neighbours comparisons; ``number`` deals the chunks of hubs."""
    worst = lists.groupBy("n").agg(F.min("s").alias("worst"), F.count(F.lit(1)).alias("have"))
    worst = worst.select("n", F.when(F.col("have") < k, F.lit(-2.0)).otherwise(F.col("worst")).alias("worst"))
    both = lists.select(F.col("n").alias("centre"), F.col("m").alias("node")).unionByName(lists.select(F.col("m").alias("centre"), F.col("n").alias("node")))
    both = both.distinct()
    long_ = cut(both.groupBy("centre").agg(F.count(F.lit(1)).alias("deg")).where(F.col("deg") >= RUN).select("centre", F.ceil(F.col("deg") / (RUN // 2)).cast("int").alias("parts")), "hubs")
    dealt = both.join(long_, "centre", "left").select("centre", "node", F.coalesce(F.pmod(F.xxhash64("node", "centre", F.lit(number)), F.col("parts")).cast("int"), F.lit(0)).alias("chunk"))
    own = both.select("centre").distinct().join(long_, "centre", "left")
    own = own.select("centre", F.col("centre").alias("node"), F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("chunk"))
    dealt = dealt.unionByName(own)
    rows = vectors.join(worst, vectors["node"] == worst["n"], "left").select("node", "dim", "vec", F.coalesce("worst", F.lit(-2.0)).alias("worst")).join(dealt, "node")
    rows = rows.select("dim", "centre", "chunk", "node", "worst", "vec").repartition("dim", "centre", "chunk").sortWithinPartitions("dim", "centre", "chunk")
    return rows.mapInArrow(_local(threshold, k, None), "kind byte, n long, m long, s double")


def _tiles(members: DataFrame, group: str, columns: Sequence[str], block: int) -> DataFrame:
    """Rows of each group in pairs of blocks (group, i, j, right, node, vec, columns), sorted by tile."""
    sizes = members.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    placed = members.join(sizes, group).withColumn("b", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    spread = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        group, F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), (F.col("b") > F.col("o")).alias("right"), "node", "vec", *columns
    )
    return spread.repartition(group, "i", "j").sortWithinPartitions(group, "i", "j", "right")


def _sides(group: list[tuple]) -> Iterator[tuple[list[tuple], list[tuple], np.ndarray, bool]]:
    """The two sides of a tile, their cosines and whether they are one block."""
    same = group[0][1] == group[0][2]
    left = [r for r in group if not r[3]]
    right = left if same else [r for r in group if r[3]]
    if left and right:
        a = np.frombuffer(b"".join([r[5] for r in left])).reshape(len(left), -1)
        b = a if same else np.frombuffer(b"".join([r[5] for r in right])).reshape(len(right), -1)
        yield left, right, a @ b.T, same


def count_links(members: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """node, n_links: exact weights of linked others inside each component (component, node, vec, weight), by pairs of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches, 3, None):
            for left, right, sims, same in _sides(group):
                near, of = sims >= threshold, lambda rows: np.array([r[6] for r in rows], np.int64)
                if same:
                    np.fill_diagonal(near, False)
                nodes, counts = [r[4] for r in left], near @ of(right)
                if not same:
                    nodes, counts = nodes + [r[4] for r in right], np.concatenate([counts, of(left) @ near])
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(counts)], names=["node", "n"])

    return _tiles(members, "component", ["weight"], block).mapInArrow(run, "node long, n long").groupBy("node").agg(F.sum("n").alias("n_links"))


def sample(vectors: DataFrame, joined: DataFrame, rows: int = AUDIT_ROWS) -> DataFrame:
    """node, stratum, dim, vec: of each stratum by hash, ``rows`` and more as the root of the table's size."""
    sizes = joined.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    kind = joined.join(sizes, "component").select("node", F.when(F.col("n") > LARGE, 2).otherwise(1).alias("stratum"))
    placed = vectors.join(kind, "node", "left").select("node", "dim", "vec", F.coalesce("stratum", F.lit(0)).alias("stratum"))
    rows = rows + 4 * math.isqrt(vectors.count())
    parts = [placed.where(F.col("stratum") == i).orderBy(F.xxhash64("node", F.lit(3)), "node").limit(rows) for i in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("node", "stratum", "dim", "vec")


def audit(vectors: DataFrame, joined: DataFrame, counted: DataFrame, threshold: float, rows: int = AUDIT_ROWS) -> float:
    """The least recall of a stratum: the mean over sampled vectors with links of the share that ``counted`` has."""
    spark = vectors.sparkSession
    chosen = sample(vectors, joined, rows).collect()
    strata = spark.createDataFrame([(r[0], r[1]) for r in chosen], "node long, stratum int")
    shared = spark.sparkContext.broadcast([(r[0], r[2], bytes(r[3])) for r in chosen])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, tuple[list, np.ndarray]] = {}
        for dim in {d for _, d, _ in shared.value}:
            own = [(n, v) for n, d, v in shared.value if d == dim]
            by[dim] = ([n for n, _ in own], np.frombuffer(b"".join([v for _, v in own])).reshape(len(own), -1))
        total = {n: 0 for n, _, _ in shared.value}
        for batch in batches:
            for dim, vec, node, weight in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if dim in by:
                    for i in np.flatnonzero(by[dim][1] @ np.frombuffer(vec.as_py()) >= threshold).tolist():
                        total[by[dim][0][i]] += weight * (by[dim][0][i] != node)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["node", "n"])

    truth = vectors.select("dim", "vec", "node", "weight").mapInArrow(run, "node long, n long").groupBy("node").agg(F.sum("n").alias("true"))
    seen = truth.where(F.col("true") > 0).join(counted, "node", "left").join(strata, "node")
    each = seen.groupBy("stratum").agg(F.avg(F.least(F.lit(1.0), F.coalesce("n_links", F.lit(0)) / F.col("true"))).alias("recall"))
    shares = [r["recall"] for r in each.collect()]
    shared.unpersist()
    return min(shares, default=1.0)


def exact_rest(vectors: DataFrame, joined: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between the components of all pairs that reach the threshold and are not in one component.

    All pairs of blocks are compared: quadratic, for what the search leaves.
    """
    labelled = cut(vectors.join(joined, "node", "left").select("dim", "node", "vec", F.coalesce("component", "node").alias("component")), "labelled")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches, 3, None):
            for left, right, sims, _ in _sides(group):
                a, b = (np.array([r[6] for r in rows], np.int64) for rows in (left, right))
                i, j = np.nonzero((sims >= threshold) & (a[:, None] != b[None, :]))
                found = np.unique(np.stack([a[i], b[j]]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["a", "b"])

    return cut(_tiles(labelled, "dim", ["component"], block).mapInArrow(run, "a long, b long").distinct(), "rest")


class Search:
    """Neighbour lists and links; what a round no longer needs is deleted."""

    def __init__(self, vectors: DataFrame, threshold: float, k: int, k_large: int) -> None:
        self.spark, self.vectors, self.live = vectors.sparkSession, vectors, vectors
        self.threshold, self.k, self.k_large = threshold, k, k_large
        self.lists: DataFrame | None = None
        self.links: DataFrame | None = None
        self.path, self.orders, self.rounds, self.thinned = None, 0, 0, 0
        self.parts = max(1, min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(vectors.count() / ORDER_ROWS)))

    def _store(self, df: DataFrame, name: str) -> tuple[DataFrame, str]:
        path = scratch(self.spark, name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def _take(self, found: DataFrame) -> None:
        """Enters the found links and candidates."""
        found, used = self._store(found, "found")
        new = cut(found.where("kind = 1").select(F.col("n").alias("a"), F.col("m").alias("b")).distinct(), "newlinks")
        self.links = new if self.links is None else self.links.unionByName(new)
        cands, old = found.where("kind = 0").select("n", "m", "s"), self.path
        cands = cands if self.lists is None else cands.unionByName(self.lists.select("n", "m", "s"))
        self.lists, self.path = self._store(_best(cands, self.threshold, self.k, self.k_large), "lists")
        if old:
            remove(self.spark, old)
        remove(self.spark, used)

    def _components(self) -> tuple[DataFrame, int]:
        """node, component; nodes in components less components (it grows whenever two are joined)."""
        joined = cut(components(self.links), "components")
        # All that later passes need of the links is which nodes they join.
        self.links = joined.select(F.col("node").alias("a"), F.col("component").alias("b"))
        n, parts = joined.agg(F.count(F.lit(1)), F.count_distinct("component")).first()
        return joined, n - parts

    def order(self, orders: int) -> None:
        first = None
        for _ in range(orders):
            one = _order(self.live, self.orders, self.parts, self.threshold, self.k)
            first = one if first is None else first.unionByName(one)
            self.orders += 1
        self._take(first)

    def descend(self) -> None:
        self._take(_descend(self.live, self.lists, self.threshold, self.k, self.rounds))
        self.rounds += 1

    def thin(self, joined: DataFrame) -> None:
        """Hold the search to ``REPS`` members of each component, others each time, and the lists to them."""
        rank = F.row_number().over(Window.partitionBy("component").orderBy("h", "node"))
        small = joined.withColumn("h", F.xxhash64("node", F.lit(self.thinned))).withColumn("slice", F.pmod("h", F.lit(SALTS)))
        self.thinned += 1
        # Each slice of a component hands on its first few, so no task sorts a large component.
        part = F.row_number().over(Window.partitionBy("component", "slice").orderBy("h", "node"))
        stay = small.withColumn("r", part).where(F.col("r") <= REPS).withColumn("r", rank).where(F.col("r") <= REPS)
        gone = cut(joined.select("node").join(stay.select("node"), "node", "left_anti"), "gone")
        self.live = cut(self.vectors.join(gone, "node", "left_anti"), "thinned")
        held = self.lists.join(gone.withColumnRenamed("node", "n"), "n", "left_anti").join(gone.withColumnRenamed("node", "m"), "m", "left_anti")
        old = self.path
        self.lists, self.path = self._store(held.select("n", "m", "s", "r"), "lists")
        remove(self.spark, old)

    def run(self, orders: int, rounds: int) -> DataFrame:
        """Orders and rounds until a pass joins nothing; the components of all links so far."""
        self.order(orders)
        joined, size = self._components()
        for _ in range(rounds):
            before = size
            self.thin(joined)
            self.descend()
            self.order(orders)
            joined, size = self._components()
            if size == before:
                break
        return joined


def near_duplicates(frame: DataFrame, threshold: float = 0.95, k: int = K, k_large: int = K_LARGE, orders: int = ORDERS, rounds: int = ROUNDS, target: float = TARGET) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``frame`` (vec_id, embedding)."""
    nodes = cut(
        unit_vectors(frame).withColumn("key", F.unhex(F.sha2("vec", 256))).withColumn("_salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")), "vectors"
    )
    # Equal vectors are one node, with the number of its rows.
    one = nodes.where("dim > 0").groupBy("key").agg(F.min("node").alias("node"), F.first("dim").alias("dim"), F.first("vec").alias("vec"), F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least"))
    known = cut(one, "different")
    vectors = known.select("node", "dim", "vec", "weight")
    search = Search(vectors, threshold, k, k_large)

    def count(joined: DataFrame) -> DataFrame:
        return cut(count_links(joined.select("node", "component").join(vectors, "node"), threshold), "counted")

    for _ in range(1 + MAX_EXTRA):
        joined = search.run(orders, rounds)
        counted = count(joined)
        if audit(vectors, joined, counted, threshold) >= target:
            break
    else:
        joined = cut(components(search.links.unionByName(exact_rest(vectors, joined, threshold))), "components")
        counted = count(joined)
    group = known.select("key", "node", "weight", "least").join(joined, "node", "left").join(counted, "node", "left").select(
        "key", "least", F.coalesce("component", "node").alias("component"), (F.col("weight") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links")
    )
    least = group.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = group.join(least, "component").select("key", F.struct("n_links", "component_id").alias("label"))
    linked = label_rows(nodes.where("dim > 0").select("vec_id", "key", "_salt"), "key", cut(labels, "labels"), "label").select("vec_id", "label.n_links", "label.component_id")
    rows = linked.unionByName(nodes.where("dim = 0").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    own = F.when(F.col("component_id").isNull() | (F.col("n_links") == 0), F.col("vec_id")).otherwise(F.col("component_id"))
    return rows.select("vec_id", "n_links", own.alias("component_id"), F.col("vec_id").eqNullSafe(own).alias("kept"))
