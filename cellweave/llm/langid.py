"""Language mixtures of documents by expectation-maximisation over n-grams.

Training counts byte trigrams of the normalised text (lower case, ASCII
non-letters as one space) per label, hashed into ``BUCKETS`` cells, over all
labelled training documents.  A document's n-grams are a mixture of the
languages' distributions; EM estimates the proportions.  The language set grows
from the best single language: the language with the largest gain of the
likelihood's derivative is added while the derivative is positive and the
fitted likelihood rises by more than half a log of the n-gram count (BIC).

Defined cases: null text and text without a letter are ``und`` with score 0; so
is every text where nothing could be learned; more than ``MAX_LABELS`` labels raise; equal proportions go to the label
first in code point order; a null identifier is not held out; repeated rows are
judged alike; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import crc_fold, forget

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
SMOOTHING = 0.5
#: The model is broadcast: BUCKETS * labels * 4 bytes, for so many labels at most.
MAX_LABELS = 512
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
SPACED = bytes(32 if b < 128 and not chr(b).isalpha() else b for b in range(256))


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Cells and counts of a whole text's trigrams."""
    words = text.lower().encode("utf-8", "replace").translate(SPACED).split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    a = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    h = a[:-2] * np.uint32(0x9E3779B1)
    h ^= a[1:-1] * np.uint32(0x85EBCA77)
    h ^= a[2:] * np.uint32(0xC2B2AE3D)
    counts = np.bincount(h >> np.uint32(32 - BUCKET_BITS), minlength=BUCKETS)
    cells = np.flatnonzero(counts)
    return cells, counts[cells].astype(np.float64)


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Labels in code point order and the n-gram probabilities (BUCKETS, labels).

    ``docs``: text, lang.  Counts are summed in each task, then by (label, cell).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                cells, counts = ngrams(text.as_py())
                if lang not in held:
                    held[lang] = np.zeros(BUCKETS, np.int64)
                held[lang][cells] += counts.astype(np.int64)
        for lang, counts in held.items():
            cells = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(cells), pa.string()), pa.array(cells.astype(np.int32)), pa.array(counts[cells])],
                names=["lang", "cell", "n"],
            )

    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    many = known.select(F.count_distinct("lang")).first()[0]
    if many > MAX_LABELS:
        raise ValueError(f"{many} labels; the model is broadcast for {MAX_LABELS} at most")
    rows = known.mapInArrow(run, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    labels = sorted(rows["lang"].unique())
    counts = np.zeros((BUCKETS, len(labels)))
    counts[rows["cell"].to_numpy(np.int64), rows["lang"].map({x: i for i, x in enumerate(labels)}).to_numpy(np.int64)] = rows["n"]
    return labels, (counts + SMOOTHING) / (counts.sum(0) + SMOOTHING * BUCKETS)


def fit(p: np.ndarray, counts: np.ndarray, start: np.ndarray, steps: int = 60, tolerance: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Proportions by EM for n-gram likelihoods ``p`` (n, languages); the mixture's likelihoods."""
    total, share = counts.sum(), start
    mixed = p @ share
    for _ in range(steps):
        new = share * ((counts / mixed) @ p) / total
        moved, share = np.abs(new - share).max(), new
        mixed = p @ share
        if moved < tolerance:
            break
    return share, mixed


def mixture(cells: np.ndarray, counts: np.ndarray, prob: np.ndarray, logs: np.ndarray) -> tuple[list[int], np.ndarray]:
    """The chosen languages and their proportions."""
    p, total = prob[cells], counts.sum()
    single = counts @ logs[cells]
    chosen, share = [int(single.argmax())], np.ones(1)
    mixed, best = p[:, chosen[0]], single.max()
    while len(chosen) < p.shape[1]:
        gain = (counts / mixed) @ p / total - 1
        gain[chosen] = -1
        new = int(gain.argmax())
        if gain[new] <= 1e-9:
            break
        share_, mixed_ = fit(p[:, [*chosen, new]], counts, np.append(share * 0.9, 0.1))
        found = counts @ np.log(mixed_)
        if found - best <= 0.5 * np.log(total):
            break
        chosen, share, mixed, best = [*chosen, new], share_, mixed_, found
    return chosen, share


def predict(docs: DataFrame, labels: list[str], prob: np.ndarray, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``carry``, then lang_pred, score and mix (label to proportion, largest first).

    The text is read from ``carry`` where it is among them, else beside them.
    """
    columns = [*carry] if "text" in carry else [*carry, "text"]
    at = columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast((labels, prob.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        names, table = shared.value
        table = table.astype(np.float64)
        logs = np.log(table)
        for batch in batches:
            langs, scores, mixes = [], [], []
            for value in batch.column(at):
                text = value.as_py()
                lang, score, mix = UNKNOWN, 0.0, []
                if text is not None and names and LETTER.search(text):
                    cells, counts = ngrams(text)
                    chosen, share = mixture(cells, counts, table, logs)
                    mix = sorted(((names[i], float(x)) for i, x in zip(chosen, share)), key=lambda m: (-m[1], m[0]))
                    lang, score = mix[0][0], min(mix[0][1], 1.0)
                langs.append(lang)
                scores.append(score)
                mixes.append(mix)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(carry)], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(mixes, pa.map_(pa.string(), pa.float64()))],
                names=[*carry, "lang_pred", "score", "mix"],
            )

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select(*columns).mapInArrow(
        run, f"{kinds}, lang_pred string, score double, mix map<string,double>"
    )


def held_out(fold: int = 2, folds: int = 4) -> "F.Column":
    return F.coalesce(crc_fold("doc_id", folds) == fold, F.lit(False))


def accept(docs: DataFrame, fold: int = 2, folds: int = 4) -> DataFrame:
    """The documents whose language is known, all columns; a null ``lang`` becomes the predicted one."""
    labels, prob = train(docs.where(~held_out(fold, folds)))
    # Columns go by place, so that none clashes with what is predicted.
    place = {c: "text" if c == "text" else f"_{i}" for i, c in enumerate(docs.columns)}
    judged = predict(docs.toDF(*place.values()), labels, prob, tuple(place.values())).where(F.col("lang_pred") != UNKNOWN)
    return judged.select(*[(F.coalesce(n, "lang_pred") if c == "lang" else F.col(n)).alias(c) for c, n in place.items()])


def identify(docs: DataFrame, fold: int = 2, folds: int = 4) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages of every document."""
    labels, prob = train(docs.where(~held_out(fold, folds)))
    return predict(docs.select("doc_id", "text"), labels, prob).select(
        "doc_id", held_out(fold, folds).alias("held_out"), "lang_pred", "score", F.map_keys("mix").alias("languages")
    )
