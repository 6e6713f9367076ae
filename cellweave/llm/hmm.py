"""A hidden Markov language model over words.

Tokens: A-Z lower-cased, split at ASCII white space, then one end token.

* Counts: ``words.count_words`` over all training documents gives N, V and the
  base (add-one unigram) score.
* Alphabet of the model: the ``vocabulary`` most frequent training words, the
  end token, and ``classes`` classes for all other words, by CRC-32 of a word's
  last three bytes.  A word of a class has probability (c + 1) / (C + V + 1)
  there (C, V: tokens and words of the class in training; the last 1 stands for
  an unknown word), so the model gives every text a probability.
* Baum-Welch: every pass goes over all training documents; a task turns its
  documents into expected counts (initial, transition, emission), partial sums
  are added in a tree and the sums give the next parameters.  Documents are
  stepped together in segments of ``SEGMENT`` tokens: the product of a segment's
  transition matrices carries the forward values in from the segment before and
  the backward values in from the segment after, so counts are those of whole
  documents, and memory does not grow with the longest one.
* Score: the scaled forward recursion over a document's symbols is its exact
  log-likelihood, plus the class terms of its rarer words.

What travels by broadcast is bounded: ``lookup`` words with their counts, and
the parameters.  Rarer words meet their counts in a join keyed by word; words
that are frequent anywhere, held-out documents included, are in the broadcast,
so that join has no hot key.

Defined cases: null and empty texts are the end token alone; repeated rows are
scored alike; null identifiers count as training; an empty table gives no rows;
without training documents every word is unknown; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cellweave.llm.common import crc_fold, cut
from cellweave.llm.words import ascii_lower_words, count_words, text_bytes, top_words

STATES = 8
PASSES = 6
SEGMENT = 65_536
#: Forward values and matrix products are scaled after so many steps.
SCALE_STEPS = 8
VOCABULARY = 16_384
LOOKUP = 200_000
CLASSES = 2_048
SEED = 17
#: Expected counts are smoothed by so much per cell.
SMOOTH = 0.05
#: Sequences are stepped together in groups of about so many tokens.
GROUP_TOKENS = 800_000
SCORE_TOKENS = 4_000_000
#: Emission counts are added up, and documents encoded, for about so many tokens at once.
EMIT_TOKENS, ENCODE_TOKENS = 1 << 17, 1 << 18


class Hmm(NamedTuple):
    start: np.ndarray  # (S,)
    move: np.ndarray  # (S, S), rows sum to 1
    emit: np.ndarray  # (symbols, S), columns sum to 1


def initial(frequency: np.ndarray, states: int = STATES, seed: int = SEED) -> Hmm:
    """States that stay, with the corpus frequencies disturbed by seeded noise."""
    rng = np.random.default_rng(seed)
    emit = (frequency + 0.5)[:, None] * rng.gamma(2.0, 0.5, (len(frequency), states))
    move = np.full((states, states), 0.1 / max(1, states - 1)) if states > 1 else np.ones((1, 1))
    if states > 1:
        np.fill_diagonal(move, 0.9)
    return Hmm(np.full(states, 1 / states), move, emit / emit.sum(0))


def grouped(sequences: list[np.ndarray], limit: int = GROUP_TOKENS) -> Iterator[np.ndarray]:
    """Positions of sequences, longest first, in groups of about ``limit`` tokens."""
    size = np.fromiter(map(len, sequences), np.int64, len(sequences))
    order = np.argsort(-size, kind="stable")
    total = np.cumsum(size[order])
    at = 0
    while at < len(order):
        base = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, base + limit, "right")))
        yield order[at:end]
        at = end


def _by_step(sequences: list[np.ndarray], which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols ordered by step (longest sequence first within a step); active sequences per step."""
    size = np.fromiter((len(sequences[i]) for i in which.tolist()), np.int64, len(which))
    flat = np.concatenate([sequences[i] for i in which.tolist()]) if len(which) else np.zeros(0, np.int64)
    step = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    order = np.argsort(step, kind="stable")
    return flat[order].astype(np.int64), np.bincount(step, minlength=int(size.max()) if len(size) else 0)


def forward(model: Hmm, symbols: np.ndarray, active: np.ndarray, begin: np.ndarray, keep: bool) -> tuple[np.ndarray, np.ndarray | None, list]:
    """Scaled forward recursion; log-likelihood of each sequence, and the scaled values (a row a token) if ``keep``.

    ``begin`` has a column a sequence.  Values are scaled every ``SCALE_STEPS``
    steps: a step's scales, None where it has none, come last.
    """
    states, loglik = len(model.start), np.zeros(active[0] if len(active) else 0)
    alphas = np.empty((len(symbols), states)) if keep else None
    scales, at, prev = [], 0, None
    for t, n in enumerate(active.tolist()):
        a = alphas[at : at + n] if keep else np.empty((n, states))
        emitted = model.emit.take(symbols[at : at + n], axis=0)
        if prev is None:
            np.multiply(emitted, begin.T, out=a)
        else:
            if n < len(prev):
                loglik[n : len(prev)] += np.log(prev[n:].sum(1))
            np.matmul(prev[:n], model.move, out=a)
            a *= emitted
        c = None
        if t % SCALE_STEPS == SCALE_STEPS - 1:
            c = a.sum(1)
            a /= c[:, None]
            loglik[:n] += np.log(c)
        scales.append(c)
        prev = a
        at += n
    if prev is not None:
        loglik[: len(prev)] += np.log(prev.sum(1))
    return loglik, alphas, scales


def products(model: Hmm, segments: list[np.ndarray], later: np.ndarray) -> np.ndarray:
    """(S, S, segments): what turns the forward values before a segment into those at its end, each up to a factor.

    A document's first segment starts from ``start`` whatever came before.
    """
    states, emit = len(model.start), np.ascontiguousarray(model.emit.T)
    out = np.empty((states, states, len(segments)))
    for which in grouped(segments, GROUP_TOKENS // states):
        symbols, active = _by_step(segments, which)
        first = np.where(later[which], model.move.T[:, :, None], np.broadcast_to(model.start[:, None, None], (states, states, 1)))
        now, at = first * emit.take(symbols[: active[0]], axis=1)[:, None, :], int(active[0])
        for t, n in enumerate(active[1:].tolist()):
            if n < now.shape[2]:
                out[:, :, which[n : now.shape[2]]] = now[:, :, n:]
                now = np.ascontiguousarray(now[:, :, :n])
            now = (model.move.T @ now.reshape(states, -1)).reshape(states, states, n)
            now *= emit.take(symbols[at : at + n], axis=1)[:, None, :]
            if t % SCALE_STEPS == 0:
                now /= now.sum((0, 1))
            at += n
        out[:, :, which[: now.shape[2]]] = now
    return out


def borders(model: Hmm, segments: list[np.ndarray], later: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(S, segments) each: forward values before a segment, backward values after it (scaled; of one document in order)."""
    before, after = np.zeros((len(model.start), len(segments))), np.ones((len(model.start), len(segments)))
    last = np.append(~later[1:], True)
    long_ = np.flatnonzero(later | ~last)
    if not len(long_):
        return before, after
    made = products(model, [segments[i] for i in long_.tolist()], later[long_])
    alpha = None
    for place, i in enumerate(long_.tolist()):
        if later[i]:
            before[:, i] = alpha
        alpha = made[:, :, place] @ (alpha if later[i] else model.start)
        alpha /= alpha.sum()
    for place in range(len(long_) - 1, -1, -1):
        i = long_[place]
        if not last[i]:
            beta = made[:, :, place + 1].T @ after[:, i + 1]
            after[:, i] = beta / beta.sum()
    return before, after


def expected(model: Hmm, sequences: list[np.ndarray], segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts of whole ``sequences``: initial, transition, emission; their log-likelihood."""
    states, total = len(model.start), 0.0
    first, moves, emits = np.zeros(states), np.zeros((states, states)), np.zeros_like(model.emit)
    cut_at = [(s, a) for s in sequences for a in range(0, len(s), segment)]
    later = np.array([a > 0 for _, a in cut_at])
    segments = [s[a : a + segment] for s, a in cut_at]
    before, after = borders(model, segments, later)
    begins = np.where(later, model.move.T @ before, model.start[:, None])
    emit, back = np.ascontiguousarray(model.emit), np.ascontiguousarray(model.move.T)
    for which in grouped(segments):
        symbols, active = _by_step(segments, which)
        loglik, alphas, scales = forward(model, symbols, active, begins[:, which], True)
        total += loglik.sum()
        ends, at, beta = np.ascontiguousarray(after[:, which].T), len(symbols), None
        for t in range(len(active) - 1, -1, -1):
            n, m, later_at = int(active[t]), 0 if beta is None else len(beta), at
            at -= n
            alpha, now = alphas[at : at + n], np.empty((n, states))
            if m < n:
                np.divide(ends[m:n], (alpha[m:] * ends[m:n]).sum(1)[:, None], out=now[m:])
            if m:
                beta *= emit.take(symbols[later_at : later_at + m], axis=0)
                if scales[t + 1] is not None:
                    beta /= scales[t + 1][:, None]
                moves += alpha[:m].T @ beta
                np.matmul(beta, back, out=now[:m])
            alpha *= now  # from here on the probabilities of states
            beta = now
        carried = later[which]
        if carried.any():  # the transition into a segment
            beta = beta * emit.take(symbols[: active[0]], axis=0)
            if scales[0] is not None:
                beta /= scales[0][:, None]
            moves += before[:, which][:, carried] @ beta[carried]
        first += alphas[: active[0]][~carried].sum(0)
        for at in range(0, len(symbols), EMIT_TOKENS):
            cells = symbols[at : at + EMIT_TOKENS, None] * states + np.arange(states)
            emits += np.bincount(cells.ravel(), alphas[at : at + EMIT_TOKENS].ravel(), minlength=emits.size).reshape(emits.shape)
    return first, moves * model.move, emits, total


def maximise(first: np.ndarray, moves: np.ndarray, emits: np.ndarray, smooth: float = SMOOTH) -> Hmm:
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    return Hmm(norm(first + smooth, 0), norm(moves + smooth, 1), norm(emits + smooth, 0))


def train(symbols: DataFrame, model: Hmm, passes: int = PASSES) -> tuple[Hmm, list[float]]:
    """Baum-Welch passes over column ``symbols`` (packed uint16 of a document)."""
    spark = symbols.sparkSession
    logs = []
    for _ in range(passes):
        shared = spark.sparkContext.broadcast(tuple(model))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, sums = Hmm(*shared.value), None
            for batch in batches:
                part = expected(now, [np.frombuffer(x.as_py(), "<u2") for x in batch.column(0)])
                sums = part if sums is None else tuple(a + b for a, b in zip(sums, part))
            if sums is not None:
                flat = np.concatenate([np.ravel(x) for x in sums])
                yield pa.RecordBatch.from_arrays([pa.array([flat.tobytes()], pa.binary())], names=["sums"])

        parts = symbols.select("symbols").mapInArrow(run, "sums binary").rdd.map(lambda r: np.frombuffer(bytes(r[0])))
        try:
            flat = parts.treeReduce(np.add)
        except ValueError:  # no training document
            return model, logs
        s = len(model.start)
        logs.append(float(flat[-1]))
        model = maximise(flat[:s], flat[s : s + s * s].reshape(s, s), flat[s + s * s : -1].reshape(model.emit.shape))
        shared.unpersist()
    return model, logs


#: Words of a document that are not in the broadcast, with their occurrences there.
RARE = pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int64())]))


class Codes(dict):
    """A number for each word of the table, for each class of other words and for the end; arrays by number say what it stands for.

    ``table``: counts of words; ``frequent``: symbols of the model's own words; ``room``: log of what a class shares out.
    """

    def __init__(self, table: dict[bytes, int], frequent: dict[bytes, int], room: np.ndarray, end: int, n_docs: int) -> None:
        super().__init__(zip(table, range(len(table))))
        self.classes, self.first, self.end, self.rare = len(room), len(table), len(table) + len(room), []
        place = np.fromiter((frequent[w] if w in frequent else end + 1 + zlib.crc32(w[-3:]) % len(room) for w in table), np.int64, len(table))
        count = np.fromiter(table.values(), np.float64, len(table))
        value = np.log10(count + 1)
        share = np.where(place < end, 0.0, value - room[np.maximum(place - end - 1, 0)])
        known = (count > 0) | (place < end)
        self.symbol = np.concatenate([place, end + 1 + np.arange(len(room)), [end]]).astype("<u2")
        self.base = np.concatenate([value, np.zeros(len(room)), [math.log10(n_docs + 1)]])
        self.share = np.concatenate([share, -room, [0.0]])
        self.known = np.concatenate([known, np.zeros(len(room), bool), [n_docs > 0]]).astype(np.int64)

    def __missing__(self, word: bytes) -> int:
        self.rare.append(word)
        return self.first + zlib.crc32(word[-3:]) % self.classes

    def taken(self) -> Counter:
        """The words that were not in the table since the last call."""
        out = Counter(self.rare)
        self.rare.clear()
        return out

    def columns(self, flat: list[int], sizes: list[int], rare: list[Counter]) -> list[pa.Array]:
        """n_tokens, n_known, base_sum, class_sum, symbols, rare of documents of ``sizes`` (1 or more) numbers each."""
        code, size = np.array(flat, np.int64), np.array(sizes, np.int64)
        border = np.append(0, np.cumsum(size))
        sums = [pa.array(np.add.reduceat(of[code], border[:-1])) for of in (self.known, self.base, self.share)]
        packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer((2 * border).astype("<i8")), pa.py_buffer(self.symbol[code])]).cast(pa.binary())
        words = pa.array([w for own in rare for w in own], pa.binary())
        times = pa.array([n for own in rare for n in own.values()], pa.int64())
        lists = pa.ListArray.from_arrays(np.append(0, np.cumsum([len(own) for own in rare])).astype(np.int32), pa.StructArray.from_arrays([words, times], fields=[*RARE.value_type]))
        return [pa.array(size), *sums, packed, lists]


def held_out(fold: int = 2, folds: int = 7) -> "F.Column":
    return F.coalesce(crc_fold("doc_id", folds) == fold, F.lit(False))


def score(docs: DataFrame, fold: int = 2, folds: int = 7, states: int = STATES, passes: int = PASSES, vocabulary: int = VOCABULARY, lookup: int = LOOKUP, classes: int = CLASSES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    folded = docs.select("doc_id", "text").withColumn("held_out", held_out(fold, folds))
    train_docs = folded.where(~F.col("held_out"))
    # Counts of training words; words of held-out documents only matter where they are hot.
    counts = cut(count_words(train_docs, ascii_lower_words), "words")
    tail = F.crc32(F.expr("substring(word, greatest(length(word) - 2, 1), 3)")) % F.lit(classes)
    totals = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("count"), F.lit(0))).first()
    n_docs = train_docs.count()
    distinct, tokens = totals[0] + (n_docs > 0), totals[1] + n_docs
    top = top_words(counts, lookup)
    hot = top_words(cut(count_words(folded.where("held_out"), ascii_lower_words), "heldwords"), lookup // 10)
    table = dict(top)
    if rest := [(bytearray(w),) for w, _ in hot if w not in table]:
        asked = spark.createDataFrame(rest, "word binary")
        table |= {bytes(w): 0 for (w,) in rest}
        table |= {bytes(w): c for w, c in counts.join(F.broadcast(asked), "word").collect()}
    frequent = {w: i for i, (w, _) in enumerate(top[:vocabulary])}
    end = len(frequent)
    mine = counts.join(F.broadcast(spark.createDataFrame([(bytearray(w),) for w in frequent], "word binary")), "word", "left_anti")
    per_class = {r[0]: (r[1], r[2]) for r in mine.groupBy(tail.alias("class")).agg(F.sum("count"), F.count(F.lit(1))).collect()}
    room = np.array([np.log10(sum(per_class.get(i, (0, 0))) + 1) for i in range(classes)])
    frequency = np.array([c for _, c in top[:vocabulary]] + [n_docs] + [per_class.get(i, (0, 0))[0] for i in range(classes)], float)
    if len(frequency) > 1 << 16:
        raise ValueError("vocabulary and classes together may hold 65,535 symbols at most")
    shared = spark.sparkContext.broadcast((table, frequent, room, n_docs))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, frequent, room, n_docs = shared.value
        codes = Codes(table, frequent, room, end, n_docs)
        schema = pa.schema([("doc_id", kind), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_sum", pa.float64()), ("class_sum", pa.float64()), ("symbols", pa.binary()), ("rare", RARE)])
        for batch in batches:
            begun, flat, sizes, rare = 0, [], [], []
            for i, text in enumerate(batch.column(2)):
                words = text.as_py().lower().split()
                flat.extend(map(codes.__getitem__, words))
                flat.append(codes.end)
                sizes.append(len(words) + 1)
                rare.append(codes.taken())
                if len(flat) >= ENCODE_TOKENS or i + 1 == batch.num_rows:
                    mine = batch.slice(begun, i + 1 - begun)
                    yield pa.RecordBatch.from_arrays([mine.column(0), mine.column(1), *codes.columns(flat, sizes, rare)], schema=schema)
                    begun, flat, sizes, rare = i + 1, [], [], []

    sql_kind = docs.schema["doc_id"].dataType.simpleString()
    kind = to_arrow_type(docs.schema["doc_id"].dataType)
    coded = text_bytes(folded, "doc_id", "held_out").mapInArrow(
        encode, f"doc_id {sql_kind}, held_out boolean, n_tokens long, n_known long, base_sum double, class_sum double, symbols binary, rare array<struct<word:binary,times:bigint>>"
    )
    coded = cut(coded.withColumn("_row", F.monotonically_increasing_id()), "symbols")
    rare = coded.select("_row", F.explode("rare").alias("r")).select("_row", "r.word", "r.times")
    found = rare.join(counts, "word").groupBy("_row").agg(
        F.sum(F.col("times") * F.log10(F.col("count") + 1)).alias("rare_sum"), F.sum("times").alias("rare_known")
    )
    model, _ = train(coded.where(~F.col("held_out")), initial(frequency, states), passes)
    fitted = spark.sparkContext.broadcast(tuple(model))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Hmm(*fitted.value)
        for batch in batches:
            sequences = [np.frombuffer(x.as_py(), "<u2") for x in batch.column(batch.num_columns - 1)]
            out = np.zeros(len(sequences))
            for which in grouped(sequences, SCORE_TOKENS):
                symbols, active = _by_step(sequences, which)
                out[which] = forward(now, symbols, active, now.start[:, None], False)[0] / np.log(10)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out)], names=[*columns, "hmm"])

    columns = ["_row", "doc_id", "held_out", "n_tokens", "n_known", "base_sum", "class_sum"]
    scored = coded.select(*columns, "symbols").mapInArrow(
        weigh, f"_row long, doc_id {sql_kind}, held_out boolean, n_tokens long, n_known long, base_sum double, class_sum double, hmm double"
    )
    rare_sum = F.coalesce("rare_sum", F.lit(0.0))
    return scored.join(found, "_row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base_sum") + rare_sum - F.col("n_tokens") * F.lit(float(np.log10(tokens + distinct + 1)))).alias("base_score"),
        (F.col("hmm") + F.col("class_sum") + rare_sum).alias("score"),
    )
