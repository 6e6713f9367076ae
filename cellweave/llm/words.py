"""Exact word counts over a corpus, with partial sums on the Python side."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import forget

#: A task hands its partial counts on when it holds so many different words.
HELD = 400_000


def text_bytes(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns and ``_text``: the text as UTF-8 bytes, null as empty."""
    return docs.select(*columns, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("_text"))


def ascii_words(text: bytes) -> list[bytes]:
    """Runs of bytes other than space, TAB, LF, VT, FF, CR."""
    return text.split()


def ascii_lower_words(text: bytes) -> list[bytes]:
    """The same with A-Z lower-cased and nothing else."""
    return text.lower().split()


def count_words(docs: DataFrame, split: Callable[[bytes], list[bytes]] = ascii_words) -> DataFrame:
    """word (binary), count (long) over all texts of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            items = list(held.items())
            held.clear()
            for at in range(0, len(items), 50_000):
                part = items[at : at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w for w, _ in part], pa.binary()), pa.array([n for _, n in part], pa.int64())],
                    names=["word", "count"],
                )

        for batch in batches:
            for text in batch.column(0):
                held.update(split(text.as_py()))
                if len(held) > HELD:
                    yield from out()
        yield from out()

    parts = text_bytes(docs).mapInArrow(run, "word binary, count long")
    return parts.groupBy("word").agg(F.sum("count").alias("count"))


def top_words(counts: DataFrame, k: int) -> list[tuple[bytes, int]]:
    """The ``k`` most frequent words (ties: smaller word first) of a written count table.

    Words below the k-th largest count are filtered out first, by a table of how
    many words have each count, so tasks do not send ``k`` rows each.
    """
    if k <= 0:
        return []
    cutoff, seen = 0, 0
    for count, words in counts.groupBy("count").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("count")).toLocalIterator():
        cutoff, seen = count, seen + words
        if seen >= k:
            break
    rows = counts.where(F.col("count") >= cutoff).orderBy(F.desc("count"), "word").limit(k).collect()
    return [(bytes(w), n) for w, n in rows]


class TwoGenerations:
    """A bounded memo: when the young half is full it becomes the old half."""

    def __init__(self, limit: int) -> None:
        self.limit, self.young, self.old = limit, {}, {}

    def missing(self, keys: list) -> list:
        """Keys that are not held; after ``put`` of those all keys are in ``young``."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        new = set(keys).difference(self.young)
        if self.old and new:
            back = new & self.old.keys()
            for key in back:
                self.young[key] = self.old[key]
            new -= back
        return list(new)

    def values(self, keys: list, learn: Callable[[list], dict]) -> list:
        """What is held of every key, after ``learn`` has given the values of those that are not held; a held key is looked up once."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        out = list(map(self.young.get, keys))
        if gaps := [i for i, v in enumerate(out) if v is None]:
            new = {keys[i] for i in gaps}
            got = {key: self.old[key] for key in new & self.old.keys()}
            if new := [key for key in new if key not in got]:
                got.update(learn(new))
            self.young.update(got)
            for i in gaps:
                out[i] = got[keys[i]]
        return out
