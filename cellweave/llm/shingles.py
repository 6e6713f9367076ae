"""Near copies by the Jaccard similarity of word-shingle sets.

Words are those of ``simhash``; a text's set holds one 64-bit hash for each of
its shingles of ``WIDTH`` words (fewer words are one shingle).  Equal sets are
one node.  Nodes that agree on all ``ROWS`` minima of one of ``BANDS`` bands
share a bucket: a pair of similarity 0.8 shares none with a probability of
(1 - 0.8^3)^30, about 5e-10.  In each bucket members meet its centre, the
member whose buckets hold the most nodes (so buckets of like members have one
centre), then the next one, and pairs of one component are left out, for
``STARS`` rounds; no pair is checked twice.

Nodes that then still share a bucket with another component meet by prefix
filtering, which is exact: with hashes in one order, rare ones first, a pair of
the similarity shares a hash early in both sets, in the first ninth of the
smaller one and the first fifth of the larger one (for 0.8), and as many hashes
follow it in both as the similarity asks for.  So a passage that many texts
share makes no pairs.

Many copies of one text that differ a little too much share nearly all hashes,
so prefixes tell them apart no longer.  Nodes that one hub (the node that is the
centre of most candidates) is likely to resemble meet by their differences from
it instead: sets x, y and c differ in |x^y| = |x^c| + |y^c| - 2 |x^c & y^c|
hashes, so a similar pair shares differences, or both resemble the hub, with
which all are compared.  Prefixes of these differences are exact in the same way
(whole sets are the differences from the empty set): copies that were changed in
different places share none early.  Nodes of different hubs meet by whole sets.

A candidate whose set sizes rule the similarity out, or that agrees on less than
``AGREE`` of all minima (a pair of similarity 0.8: with a probability below
1e-11), goes no further; every other one is checked on its whole sets, which are
made for the nodes of such candidates and those of the prefix filter only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import cut, drop, first_rows, forget, numbered, within
from cellweave.llm.components import components, label_rows
from cellweave.llm.words import text_bytes

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 30, 3
STARS = 3
SALTS = 64
#: Counters of the hashes' frequency, on the driver and in every Python worker; they order hashes and decide no link.
SLOTS = 1 << 20
#: Share of ``SIMILARITY`` that a candidate's agreement on minima must reach.
AGREE = 0.55
#: Odd multipliers, from a fixed seed: of the words of a shingle (the last one mixes their sum) and of the minima.
_RNG = np.random.default_rng(42)
PLACES = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TURNS = _RNG.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted different hashes of a whole text's shingles."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    many = max(1, len(words) - width + 1)
    out = np.zeros(many, np.uint64)
    for i in range(min(width, len(words))):
        out += each[i : i + many] * PLACES[i]
    out ^= out >> np.uint64(32)
    out *= PLACES[-1]
    return np.unique(out ^ (out >> np.uint64(29)))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of a set under each of ``BANDS * ROWS`` hash functions."""
    high, least = (hashes >> np.uint64(32)).astype(np.uint32), np.full(BANDS * ROWS, (1 << 32) - 1, np.uint32)
    for at in range(0, len(high), 512):
        np.minimum(least, (high[at : at + 512, None] * TURNS).min(0), out=least)
    return least


def bands(least: np.ndarray) -> list[int]:
    """One signed key a band."""
    raw, size = least.tobytes(), least.itemsize * ROWS
    return [int(np.uint64(xxhash.xxh64_intdigest(raw[i * size : (i + 1) * size], i)).astype(np.int64)) for i in range(BANDS)]


def _signed(rows: DataFrame) -> DataFrame:
    """_row, key (of the whole set), n (its size), minima, bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        schema = pa.schema([("_row", pa.int64()), ("key", pa.binary()), ("n", pa.int64()), ("minima", pa.binary()), ("bands", pa.list_(pa.int64()))])
        for batch in batches:
            out = []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                hashes = shingle_set(text.as_py())
                least = minima(hashes)
                out.append((row, xxhash.xxh3_128_digest(hashes.tobytes()), len(hashes), least.tobytes(), bands(least)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return text_bytes(rows, "_row").mapInArrow(run, "_row long, key binary, n long, minima binary, bands array<long>")


def _likely(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) that sizes and minima do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, BANDS * ROWS) for i in (2, 3))
            stay = pa.array((x == y).mean(1) >= least * AGREE)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(stay), batch.column(1).filter(stay)], names=["a", "b"])

    asked = within(nodes.select("node", "n", "minima"), _ends(pairs), "node")
    left = asked.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("minima").alias("x"))
    right = asked.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("minima").alias("y"))
    sized = _beside(pairs.join(left, "a"), right).where(F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(least))
    near = cut(sized.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "likely")
    drop(asked)
    return near


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def _beside(pairs: DataFrame, right: DataFrame) -> DataFrame:
    """``pairs`` joined to ``right`` by b, per (b, salt): the centre of a large bucket is in many pairs."""
    salted = pairs.withColumn("_salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int"))
    return salted.join(salted.select("b", "_salt").distinct().join(right, "b"), ["b", "_salt"])


def _sets(texts: DataFrame) -> DataFrame:
    """node, hashes (the packed shingle set) of ``texts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())], names=["node", "hashes"])

    return texts.select("_row", "_text").mapInArrow(run, "node long, hashes binary")


def _checked(pairs: DataFrame, nodes: DataFrame, least: float, texts: DataFrame | None = None, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b) whose sets, ``known`` or those of ``texts``, have a similarity of ``least`` or more, and those of ``_likely``."""
    near = _likely(pairs, nodes, least)
    asked = within(texts, _ends(near)) if known is None else within(known, _ends(near), "node")
    sets = cut(_sets(asked), "shingles", True) if known is None else asked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = zip(*((np.frombuffer(v.as_py(), np.uint64) for v in batch.column(i)) for i in (2, 3)))
            stay = pa.array([similarity(x, y) >= least for x, y in sets], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(stay), batch.column(1).filter(stay)], names=["a", "b"])

    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    out = cut(_beside(near.join(left, "a"), right).select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "checked", True)
    drop(asked, *([sets] if known is None else []))
    return out, near


def prefixes(d: int, least: float, n: int, centre: int = 0) -> tuple[int, int]:
    """How many of the first of a set's ``d`` differences from a ``centre`` hold one of any similar set, with no fewer differences or any number.

    ``n``, ``centre``: sizes of the sets.  Similar sets that share none both resemble the centre.
    """
    apart = (1 - least) / (1 + least)  # similar sets differ in this share of their sizes' sum at most
    shared = ((2 - apart) * d - apart * (n + centre)) / 2, (d - apart * (n + centre)) / (1 + apart)
    return tuple(min(d, int(d - max(1, np.ceil(x - 1e-9)) + 1)) for x in shared)


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(20)).astype(np.int64) % SLOTS


def _frequencies(sets: DataFrame) -> np.ndarray:
    """How many sets have a hash of each slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(SLOTS, np.int64)
        for batch in batches:
            held += np.bincount(_slot(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64)), minlength=SLOTS)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(held[at])], names=["slot", "n"])

    found = cut(sets.select("hashes").mapInArrow(run, "slot int, n long"), "slots", True)
    sums = found.groupBy("slot").agg(F.least(F.sum("n"), F.lit((1 << 31) - 1)).cast("int").alias("n")).toArrow()
    drop(found)
    out = np.zeros(SLOTS, np.int32)
    out[sums.column("slot").to_numpy()] = sums.column("n").to_numpy()
    return out


def _differences(sets: DataFrame, hubs: DataFrame, least: float) -> DataFrame:
    """node, hub, n, centre (the hub's size), hashes (packed, those of one of both sets, mixed with the hub), near (similar to the hub) of ``hubs`` (node, hub)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("node", pa.int64()), ("hub", pa.int64()), ("n", pa.int64()), ("centre", pa.int64()), ("hashes", pa.binary()), ("near", pa.bool_())])
        for batch in batches:
            out = []
            for node, hub, x, y in zip(*(batch.column(i).to_pylist() for i in range(4))):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                apart = np.setxor1d(x, y, assume_unique=True) ^ np.uint64(xxhash.xxh64_intdigest(hub.to_bytes(8, "little", signed=True)))
                out.append((node, hub, len(x), len(y), apart.tobytes(), similarity(x, y) >= least))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    pairs = hubs.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    pairs = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")
    beside = _beside(pairs, sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")))
    return cut(beside.select("a", "b", "x", "y").mapInArrow(run, "node long, hub long, n long, centre long, hashes binary, near boolean"), "differences", True)


def _prefixed(sets: DataFrame, least: float) -> DataFrame:
    """hash, node, n, d (its hashes here), at (the hash's place among them, from 0), short (in the prefix of a set that has the fewer ones).

    ``sets``: node, n, centre, hashes.  Hashes are ordered by frequency of the
    slot; those of a slot with one are in one set and left out.
    """
    counts = sets.sparkSession.sparkContext.broadcast(_frequencies(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for node, n, centre, packed in zip(*(batch.column(i).to_pylist() for i in range(4))):
                hashes = np.frombuffer(packed, np.uint64)
                many = counts.value[_slot(hashes)]
                short, long = prefixes(len(hashes), least, n, centre)
                first = np.lexsort((hashes, many))[:long]
                at = np.flatnonzero(many[first] > 1)
                each = hashes[first[at]].view(np.int64)
                out.append((each, *(np.full(len(at), v) for v in (node, n, len(hashes))), at, at < short))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["hash", "node", "n", "d", "at", "short"])

    return sets.select("node", "n", "centre", "hashes").mapInArrow(run, "hash long, node long, n long, d long, at long, short boolean")


def _across(sets: DataFrame, parts: DataFrame, least: float, by: str) -> DataFrame:
    """Pairs (a, b) of different ``parts`` (node, part, hub) and different ``by`` (part or hub) that prefixes and places do not rule out.

    Nodes of the ``by`` with the most nodes of a hash do not meet each other.
    """
    rows = cut(_prefixed(sets, least).join(parts.select("node", "part", F.col(by).alias("side")), "node"), "prefixes", True)
    sizes = rows.groupBy("hash", "side").agg(F.count(F.lit(1)).alias("m"))
    most = sizes.groupBy("hash").agg(F.max(F.struct("m", "side")).alias("most"), F.count(F.lit(1)).alias("sides")).where("sides > 1")
    rows_of = cut(rows.join(most.select("hash", F.col("most.side").alias("main")), "hash").withColumn("lone", F.col("side") != F.col("main")), "crossing")

    def meet(smaller: DataFrame, larger: DataFrame) -> DataFrame:
        x, y = (rows.select("hash", *[F.col(c).alias(c + end) for c in ("node", "n", "d", "part", "side")], (F.col("d") - F.col("at")).alias("rest" + end)) for rows, end in ((smaller.where("short"), "_x"), (larger, "_y")))
        order = (F.col("d_x") < F.col("d_y")) | ((F.col("d_x") == F.col("d_y")) & (F.col("node_x") < F.col("node_y")))
        sized = F.least("n_x", "n_y") >= F.greatest("n_x", "n_y") * F.lit(least) - F.lit(1e-9)
        apart = (F.col("n_x") + F.col("n_y")) * F.lit((1 - least) / (1 + least))
        placed = F.least("rest_x", "rest_y") >= (F.col("d_x") + F.col("d_y") - apart) / 2 - F.lit(1e-9)
        differ = (F.col("part_x") != F.col("part_y")) & (F.col("side_x") != F.col("side_y"))
        return y.join(x, "hash").where(differ & order & sized & placed).select(F.col("node_y").alias("a"), F.col("node_x").alias("b"))

    pairs = cut(meet(rows_of.where("lone"), rows_of).unionByName(meet(rows_of.where("not lone"), rows_of.where("lone"))).distinct(), "pairs")
    drop(rows, rows_of)
    return pairs


def _hubs(likely: list[DataFrame]) -> DataFrame:
    """node, hub of the nodes of ``likely`` pairs (a, centre b): of its centres and itself the one with the most pairs, then in turn that one's."""
    pairs = reduce(DataFrame.unionByName, likely).select("a", "b")
    many = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("m"))
    each = _beside(pairs, many).select("a", "b", "m").unionByName(many.select(F.col("b").alias("a"), "b", "m"))
    once = cut(each.groupBy("a").agg(F.max(F.struct("m", (-F.col("b")).alias("b"))).alias("most")).select("a", (-F.col("most.b")).alias("b")), "hubs")
    out = cut(_beside(once, once.select(F.col("a").alias("b"), F.col("b").alias("hub"))).select(F.col("a").alias("node"), "hub"), "hubs")
    drop(once)
    return out


def _left(now: DataFrame, texts: DataFrame, likely: list[DataFrame], met: list[DataFrame], least: float) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) not yet ``met`` by which nodes of different parts of ``now`` (node, part) can be linked, and the sets (node, hashes) of all of them."""
    parts = now.select("node", "part").distinct()
    hubs = _hubs(likely) if likely else None
    parts = cut(parts.join(hubs, "node", "left").withColumn("hub", F.coalesce("hub", "node")) if likely else parts.withColumn("hub", F.col("node")), "parts")
    asked = within(texts, parts.select("node").union(parts.select("hub")).distinct())
    sets = cut(_sets(asked), "shingles", True)
    apart = _differences(sets, parts, least)
    whole = sets.select("node", F.expr("length(hashes) div 8").alias("n"), F.lit(0).cast("long").alias("centre"), "hashes")
    found = [_across(apart, parts, least, "part"), _across(whole, parts, least, "hub")]
    pairs = reduce(DataFrame.unionByName, [*found, apart.where("near").select(F.col("node").alias("a"), F.col("hub").alias("b"))])
    pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    before = [older.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")) for older in met]
    out = cut(reduce(lambda p, older: p.join(older, ["a", "b"], "left_anti"), before, pairs), "pairs")
    drop(parts, asked, apart, *found, *([hubs] if likely else []))
    return out, sets


def link(nodes: DataFrame, texts: DataFrame, least: float = SIMILARITY, stars: int = STARS) -> DataFrame:
    """node, component of the linked ones of ``nodes`` (node, n, minima, bands; a written table)."""
    rows = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    held = cut(rows.join(shared, "bucket"), "buckets")
    score = held.groupBy("node").agg(F.sum("n").alias("score"))
    rows = cut(held.join(score, "node").select("bucket", "node", "score"), "buckets")
    drop(held)
    joined, met, likely = None, [], []
    for star in range(stars + 1):
        now = rows if joined is None else rows.join(joined, "node", "left")
        now = now.withColumn("part", F.col("node") if joined is None else F.coalesce("component", "node")).select("bucket", "node", "score", "part")
        mixed = now.groupBy("bucket").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("bucket")
        now = cut(now.join(mixed, "bucket") if star else now, "mixed")
        drop(rows)
        if star < stars:
            centre = now.groupBy("bucket").agg(F.max(F.struct("score", -F.col("node"), "node", "part")).alias("c"))
            pairs = now.join(centre, "bucket").where("node <> c.node and part <> c.part").select(F.col("node").alias("a"), F.col("c.node").alias("b")).distinct()
            met.append(cut(reduce(lambda p, older: p.join(older, ["a", "b"], "left_anti"), met, pairs), "pairs"))
            new, near = _checked(met[-1], nodes, least, texts)
            likely.append(near)
            rows = cut(now.join(centre, "bucket").where("node <> c.node").select("bucket", "node", "score"), "left")
        else:
            pairs, sets = _left(now, texts, likely, met, least)
            new, near = _checked(pairs, nodes, least, known=sets)
            drop(pairs, near, sets, *met, *likely)
        drop(now)
        if joined is None or not new.isEmpty():
            known = new if joined is None else new.unionByName(joined.select(F.col("node").alias("a"), F.col("component").alias("b")))
            older, joined = joined, cut(components(known), "joined")
            drop(*([older] if older is not None else []))
        drop(new)
    return joined


def keep_one(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each component: the first by (null id last, doc_id, hash of the text, hash of the row)."""
    rows = numbered(docs)
    signed = cut(_signed(rows), "signed", True)
    known = cut(signed.groupBy("key").agg(F.min("_row").alias("node"), *[F.first(c).alias(c) for c in ("n", "minima", "bands")]), "sets")
    joined = link(known.drop("key"), text_bytes(rows, "_row"), least)
    group = known.select("key", "node").join(joined, "node", "left").select("key", F.coalesce("component", "node").alias("component"))
    salted = signed.select("_row", "key").withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int"))
    out = first_rows(rows, label_rows(salted, "key", group, "component").select("_row", "component"), docs.columns)
    drop(signed, known, joined)
    return out
