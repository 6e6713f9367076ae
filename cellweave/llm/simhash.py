"""SimHash near-duplicates with BK-trees.

Fingerprint: A-Z lower-cased, words split at ASCII white space, shingles of
``width`` words with repeats, XXH64 (seed 42) of each; a bit is 1 where more
than half of the hashes have it.  Fingerprints link at ``radius`` or fewer
differing bits; components follow links.

Different fingerprints only are searched.  They are dealt to shards: the 64
bits are cut in ``radius + agree`` blocks, so fingerprints within the radius
agree on at least ``agree`` of them, and every choice of ``agree`` blocks with
their values is a shard.  A shard's BK-tree (children keyed by integer Hamming
distance to the parent) is built and searched in one task, following only edges
within the radius; what a search finds leaves the tree, so a group of m near
copies costs m spanning links, not m * m pairs.  A shard with more than
``chunk`` members is split: its chunks have trees of their own, and those trees
meet the other chunks by a broadcast join while their bytes stay below
``broadcast_bytes``, by a join on (shard, pair of chunks) beyond that.

Defined cases: null text, empty text and text without words have fingerprint 0,
which links like any other; fewer than ``width`` words are one shingle; repeated
identifiers are separate rows in one component; a null identifier never is the
smallest one unless its component has no other; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import cut, first_rows, forget, numbered
from cellweave.llm.components import components, label_rows
from cellweave.llm.words import text_bytes

SEED = 42
CHUNK = 4096
#: Shards hold about so many fingerprints before ``agree`` grows.
SHARD_ROWS = 512
BROADCAST_BYTES = 64 << 20
SALTS = 64


def fingerprint(text: bytes, width: int = 4) -> int:
    """The 64-bit SimHash of a whole text, unsigned."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    begin = (end - size)[: len(words) - width + 1].tolist()
    digest, out = xxhash.xxh64_intdigest, 0
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(begin, end[width - 1 :].tolist())], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):  # bounded memory for very long texts
        bits = np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    for i in np.flatnonzero(2 * ones > len(hashes)).tolist():
        out |= 1 << i
    return out


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


class BKTree:
    """Integer Hamming distances; members can be taken out."""

    def __init__(self) -> None:
        self.value: list[int] = []
        self.kids: list[dict[int, int]] = []
        self.parent: list[int] = []
        self.here: list[bool] = []
        self.live: list[int] = []  # members in the subtree

    def insert(self, value: int) -> int:
        new, at = len(self.value), 0
        self.value.append(value)
        self.kids.append({})
        self.here.append(True)
        self.live.append(1)
        self.parent.append(-1)
        while new:
            self.live[at] += 1
            d = (self.value[at] ^ value).bit_count()
            kid = self.kids[at].get(d)
            if kid is None:
                self.kids[at][d] = new
                self.parent[new] = at
                break
            at = kid
        return new

    def remove(self, node: int) -> None:
        self.here[node] = False
        while node >= 0:
            self.live[node] -= 1
            node = self.parent[node]

    def within(self, value: int, radius: int) -> list[int]:
        """Members at distance ``radius`` or less, by edges within the radius only."""
        found, stack = [], [0] if self.value else []
        while stack:
            at = stack.pop()
            if not self.live[at]:
                continue
            d = (self.value[at] ^ value).bit_count()
            if d <= radius and self.here[at]:
                found.append(at)
            for edge, kid in self.kids[at].items():
                if -radius <= edge - d <= radius:
                    stack.append(kid)
        return found


def local_roots(values: list[int], radius: int) -> list[int]:
    """For each of the (different) values, the position of its component's first member."""
    if len(values) == 2:  # most shards
        return [0, 0 if (values[0] ^ values[1]).bit_count() <= radius else 1]
    tree = BKTree()
    for v in values:
        tree.insert(v)
    root = [-1] * len(values)
    for i in range(len(values)):
        if root[i] >= 0:
            continue
        root[i], queue = i, [i]
        tree.remove(i)
        while queue:
            for j in tree.within(values[queue.pop()], radius):
                root[j] = i
                tree.remove(j)
                queue.append(j)
    return root


def blocks(n: int) -> list[tuple[int, int]]:
    """(shift, bits) of ``n`` nearly equal blocks of 64 bits."""
    size = [64 // n + (i < 64 % n) for i in range(n)]
    return [(sum(size[:i]), s) for i, s in enumerate(size)]


def shard_keys(radius: int, agree: int) -> "F.Column":
    """Array of shard keys of column ``fp``: the choice of blocks and a hash of their values."""
    cuts, keys = blocks(radius + agree), []
    for number, chosen in enumerate(combinations(range(len(cuts)), agree)):
        parts = [F.shiftrightunsigned("fp", cuts[i][0]).bitwiseAND(F.lit((1 << cuts[i][1]) - 1)) for i in chosen]
        value = parts[0]
        for part, i in zip(parts[1:], chosen[1:]):
            value = F.shiftleft(value, cuts[i][1]).bitwiseOR(part)
        keys.append(value * F.lit(64) + F.lit(number) if agree < 4 else F.xxhash64(F.lit(number), *parts))
    return F.array(*keys)


def agree_for(n: int, radius: int) -> int:
    """How many blocks a shard fixes, so that shards of ``n`` scattered fingerprints stay small."""
    agree = 1
    while agree < 3 and n > SHARD_ROWS << min(bits for _, bits in blocks(radius + agree)) * agree:
        agree += 1
    return agree


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[int]]]:
    """Runs of (key, chunk) in sorted rows (key, chunk, fp)."""
    held: list[int] = []
    last = None
    for batch in batches:
        key, chunk, fp = (batch.column(i).to_numpy() for i in range(3))
        if not len(key):
            continue
        edge = np.flatnonzero((key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1])) + 1
        bounds = [0, *edge.tolist(), len(key)]
        values = fp.tolist()
        for a, b in zip(bounds, bounds[1:]):
            this = (int(key[a]), int(chunk[a]))
            if this != last:
                if held:
                    yield *last, held
                held, last = [], this
            held.extend(values[a:b])
    if held:
        yield *last, held


def link(distinct: DataFrame, radius: int = 4, agree: int | None = None, chunk: int = CHUNK, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Spanning links (a, b) of all components of column ``fp`` (different longs)."""
    agree = agree or agree_for(distinct.count(), radius)
    keyed = distinct.select("fp", F.explode(shard_keys(radius, agree)).alias("key"))
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    large = cut(counts.where(F.col("n") > chunk).select("key", F.ceil(F.col("n") / F.lit(chunk)).cast("int").alias("parts")), "hotshards")
    hot = large.count() > 0
    if hot:
        dealt = keyed.join(large, "key", "left").select(
            "key", F.coalesce(F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).cast("int"), F.lit(-1)).alias("chunk"), "fp"
        )
    else:
        dealt = keyed.select("key", F.lit(-1).alias("chunk"), "fp")
    dealt = dealt.repartition("key", "chunk").sortWithinPartitions("key", "chunk", "fp")

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("chunk", pa.int32()), ("fps", pa.list_(pa.int64())), ("roots", pa.list_(pa.int64()))])
        rows = []
        for key, part, values in _chunks(batches):
            if len(values) < 2 and part < 0:
                continue
            root = local_roots([v & (1 << 64) - 1 for v in values], radius)
            if part < 0:  # only links are of use
                pairs = [(v, values[r]) for i, (v, r) in enumerate(zip(values, root)) if r != i]
                if not pairs:
                    continue
                values, roots = [v for v, _ in pairs], [r for _, r in pairs]
            else:
                roots = [values[r] for r in root]
            rows.append((key, part, values, roots))
            if len(rows) >= 256:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    trees = cut(dealt.mapInArrow(grow, "key long, chunk int, fps array<long>, roots array<long>"), "bktrees")
    local = trees.select(F.explode(F.arrays_zip("fps", "roots")).alias("p")).select(F.col("p.fps").alias("a"), F.col("p.roots").alias("b")).where("a <> b")
    if not hot:
        return local

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = (1 << 64) - 1
        for batch in batches:
            for row in batch.to_pylist():
                values, roots = row["fps"], row["roots"]
                tree, joined, out = BKTree(), {}, []
                for v in values:
                    tree.insert(v & full)
                kinds = len(set(roots))
                for v, mine in zip(row["other_fps"], row["other_roots"]):
                    known = joined.setdefault(mine, set())
                    if len(known) == kinds:
                        continue
                    for at in tree.within(v & full, radius):
                        if roots[at] not in known:
                            known.add(roots[at])
                            out.append((mine, roots[at]))
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])

    split = trees.where("chunk >= 0")
    size = split.agg(F.sum(F.size("fps") * 16)).first()[0] or 0
    trees_of = split.select("key", F.col("chunk").alias("i"), "fps", "roots")
    others = split.select("key", F.col("chunk").alias("j"), F.col("fps").alias("other_fps"), F.col("roots").alias("other_roots"))
    if size <= broadcast_bytes:
        pairs = others.repartition("key", "j").join(F.broadcast(trees_of), "key").where("i < j")
    else:  # every pair of chunks is a key of its own
        pairs = trees_of.join(large, "key").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("i < j").drop("parts").join(
            others.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("j")))).where("i < j"), ["key", "i", "j"]
        )
    return local.unionByName(pairs.select("fps", "roots", "other_fps", "other_roots").mapInArrow(meet, "a long, b long"))


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            fps = [signed(fingerprint(t.as_py(), width)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return text_bytes(docs, "doc_id").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4, **how) -> DataFrame:
    """doc_id, fingerprint (hex), component_id of every document."""
    rows = cut(fingerprints(docs, width).withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")), "fingerprints", True)
    known = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    joined = components(link(known.select("fp"), radius, **how))
    member = known.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    smallest = member.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = member.join(smallest, "component").select("fp", "component_id")
    return label_rows(rows, "fp", labels, "component_id").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, width: int = 4, radius: int = 4, **how) -> DataFrame:
    """``docs`` with one document of each component: the first by (null id last, doc_id, hash of the text, hash of the row)."""
    rows = numbered(docs)
    groups = near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), width, radius, **how)
    groups = groups.select(F.col("doc_id").alias("_row"), F.col("component_id").alias("component"))
    return first_rows(rows, groups, docs.columns)
