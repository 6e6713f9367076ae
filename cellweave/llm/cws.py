"""Document fingerprints by consistent weighted sampling.

A text's terms are its words (A-Z lower-cased, split at ASCII white space),
weighted by the bytes they cover.  Of words of more than ``LONG`` bytes (scripts
without spaces, codes) the terms are all runs of ``GRAM`` code points, which share
the word's bytes, so that a change touches its own place only.  For each of ``SAMPLES`` independent draws a term x of weight w gets, from
hashes of (term, draw) alone, r and c ~ Gamma(2, 1) and b ~ U(0, 1);
t = floor(ln w / r + b), ln a = ln c - r (t - b + 1), and the smallest a names the
sample (x, t).  Two texts draw the same sample with the probability of their
generalised Jaccard similarity; the fingerprint holds 16 bits of each sample,
and the share of equal ones estimates that similarity.

``edits`` fingerprints every document and its edited text (the last quarter of
its code points replaced by the first as many of the next document).  One range
shuffle brings documents in order; a partition's last document meets the first
of the next partition in a small second step.

Defined cases: a null text is an empty one; a text without words has the
all-zero fingerprint, whose likeness to another empty one is 1; equal texts have
equal fingerprints; documents of one id are ordered by a hash of their text;
null ids come first; a single document is its own next; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import cut
from cellweave.llm.words import text_bytes

SAMPLES = 64
LONG, GRAM = 32, 4
SEED = 0
#: Documents are fingerprinted in runs of about so many bytes.
RUN_BYTES = 1 << 20
#: Terms whose draws are held at a time, for one very long text.
TERMS_AT_ONCE = 8192


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def draws(terms: np.ndarray, samples: int = SAMPLES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c and b of every (term hash, draw)."""
    step = np.uint64(0x9E3779B97F4A7C15)
    j = np.arange(samples, dtype=np.uint64) * np.uint64(2)
    one = _mix(terms[:, None] + (j + np.uint64(1)) * step)
    two = _mix(terms[:, None] + (j + np.uint64(2)) * step)
    low, scale = np.uint64((1 << 21) - 1), np.float32(1 / (1 << 21))
    unit = lambda x, s: ((x >> np.uint64(s)) & low).astype(np.float32) * scale + scale / 2
    r = -np.log(unit(one, 0) * unit(one, 21))
    c = np.log(-np.log(unit(one, 42) * unit(two, 0)))
    return r, c, unit(two, 21)


def terms_of(text: bytes) -> Counter:
    """Weighted terms of a whole text: bytes covered by each."""
    own = Counter(text.lower().split())
    out = Counter({w: n * len(w) for w, n in own.items()})
    for w in [w for w in own if len(w) > LONG]:
        points = w.decode("utf-8", "replace")
        grams = Counter(points[i : i + GRAM] for i in range(len(points) - GRAM + 1))
        share = out.pop(w) / sum(grams.values())
        for g, n in grams.items():
            out[g.encode()] += n * share
    return out


def signatures(texts: Sequence[bytes], samples: int = SAMPLES) -> np.ndarray:
    """(texts, samples) array of uint16."""
    weighted = [terms_of(t) for t in texts]
    place: dict[bytes, int] = {}
    index = [np.fromiter((place.setdefault(w, len(place)) for w in own), np.int64, len(own)) for own in weighted]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(w, SEED) for w in place), np.uint64, len(place))
    out = np.zeros((len(texts), samples), np.uint16)
    held = draws(hashes, samples) if len(place) <= 8 * TERMS_AT_ONCE else None
    salt = np.arange(samples, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    column = np.arange(samples)
    for i, (own, at) in enumerate(zip(weighted, index)):
        if not len(at):
            continue
        lnw = np.log(np.fromiter(own.values(), np.float64, len(own))).astype(np.float32)[:, None]
        best = key = None
        for a in range(0, len(at), TERMS_AT_ONCE):
            part = at[a : a + TERMS_AT_ONCE]
            r, c, b = (x[part] for x in held) if held else draws(hashes[part], samples)
            t = np.floor(lnw[a : a + TERMS_AT_ONCE] / r + b)
            lna = c - r * (t - b + np.float32(1))
            low = lna.argmin(0)
            sample = hashes[part][low] ^ t[low, column].astype(np.int64).view(np.uint64) * np.uint64(0x9FB21C651E98DF25)
            value = lna[low, column]
            if best is None:
                best, key = value, sample
            else:
                less = value < best
                best, key = np.where(less, value, best), np.where(less, sample, key)
        out[i] = (_mix(key + salt) >> np.uint64(48)).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edit(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of ``following``."""
    n = len(text)
    return text[: n - n // 4] + following[: n // 4]


def _work(texts: list[str], following: str) -> list[tuple]:
    """n_chars, fingerprint, edited sha, edited fingerprint, likeness to edited and to next, of ``texts``."""
    after = [*texts[1:], following]
    edited = [edit(t, n) for t, n in zip(texts, after)]
    coded = [t.encode() for t in edited]
    sig = signatures([*(t.encode() for t in texts), following.encode(), *coded])
    own, changed = sig[: len(texts) + 1], sig[len(texts) + 1 :]
    return [
        (len(t), own[i].tobytes(), hashlib.sha256(coded[i]).hexdigest(), changed[i].tobytes(), likeness(own[i], changed[i]), likeness(own[i], own[i + 1]))
        for i, t in enumerate(texts)
    ]


RESULT = "n_chars long, fp binary, edited_sha256 string, edited_fp binary, near_edited double, near_next double"


def edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = [("n_chars", pa.int64()), ("fp", pa.binary()), ("edited_sha256", pa.string()), ("edited_fp", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())]

    def rows(ids: list, results: list[tuple], part: int, first: list[bool], last: list[bool], texts: list, id_type: pa.DataType) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, (_, t) in zip(zip(*results), fields)]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, id_type), pa.array([part] * len(ids), pa.int32()), pa.array(first), pa.array(last), pa.array(texts, pa.binary()), *columns],
            names=["doc_id", "part", "first", "last", "edge_text", *[n for n, _ in fields]],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, opened, ids, texts, size, id_type = TaskContext.get().partitionId(), False, [], [], 0, None
        for batch in batches:
            id_type = batch.column(0).type
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = value.as_py()
                text = raw.decode("utf-8", "replace")
                if size >= RUN_BYTES:
                    edge = [None if opened or i else t.encode() for i, t in enumerate(texts)]
                    yield rows(ids, _work(texts, text), part, [not opened and not i for i in range(len(ids))], [False] * len(ids), edge, id_type)
                    opened, ids, texts, size = True, [], [], 0
                ids.append(doc_id)
                texts.append(text)
                size += len(raw)
        if ids:  # the last document's next one is not known here
            n = len(ids)
            first, last = [not opened and not i for i in range(n)], [i == n - 1 for i in range(n)]
            edge = [t.encode() if a or b else None for t, a, b in zip(texts, first, last)]
            yield rows(ids, _work(texts, ""), part, first, last, edge, id_type)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = text_bytes(docs, "doc_id").withColumn("_tie", F.xxhash64("_text"))
    ordered = ordered.repartitionByRange(parts, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").select("doc_id", "_text")
    main = cut(ordered.mapInArrow(run, f"doc_id {kind}, part int, first boolean, last boolean, edge_text binary, {RESULT}"), "cws")

    order = sorted(r[0] for r in main.where("first").select("part").collect())  # one number a partition
    follows = spark.createDataFrame(list(zip(order, [*order[1:], *order[:1]])), "part int, next_part int")
    heads = main.where("first").select(F.col("part").alias("next_part"), F.col("edge_text").alias("next_text"))
    tails = main.where("last").select("doc_id", "part", "edge_text").join(F.broadcast(follows), "part").join(heads, "next_part")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results = [_work([a.as_py().decode("utf-8", "replace")], b.as_py().decode("utf-8", "replace"))[0] for a, b in zip(batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in results], t) for i, (_, t) in enumerate(fields)]], names=["doc_id", *[n for n, _ in fields]])

    closed = tails.select("doc_id", "edge_text", "next_text").mapInArrow(close, f"doc_id {kind}, {RESULT}")
    whole = main.where("not last").select("doc_id", *[n for n, _ in fields]).unionByName(closed)
    shown = lambda c: F.lower(F.hex(c))
    return whole.select(
        "doc_id", "n_chars", "edited_sha256", shown("fp").alias("fingerprint"), shown("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next"
    )
