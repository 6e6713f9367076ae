"""Entropy balancing: document rates that meet token targets per source.

Document rates r minimise the relative entropy to one copy each, subject to
sum(r * size) = target for every source and 0 <= r <= ``max_copies``.  The
convex dual has one multiplier a source and the solution is exponentially
tilted, r = min(max_copies, exp(lambda * size / mean size)).  Newton's method
solves the dual: every iteration is one aggregation over the (source, size)
histogram, which holds all documents exactly (documents of one source and size
share a rate) and is far smaller than they are; only (source, lambda) pairs
live on the driver.

Rates become copies by error feedback over the sizes of a source from largest
to smallest: what one size takes too much or too little the next evens out, so
a source ends within half its smallest size of its target where sizes allow
it.  Within a size, copies differ by at most one between documents, and a hash
of the identifier orders them.  Hot (source, size) groups are ranked in pieces.

Defined cases: null text and text without words have size 0, one copy and take
nothing; a null source is a source of its own, ordered last; sources without
words have target 0; more than ``MAX_SOURCES`` sources raise; repeated documents are mixed as separate rows; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.llm.common import cut, driver_table, numbered, repeated

#: Rows of a (source, size) group that one window partition ranks, about.
PIECE_ROWS = 1024
#: A (source, size) table of up to so many rows of 64 bytes is broadcast.
BROADCAST_ROWS = 100_000
#: One multiplier a source is kept on the driver, for so many sources at most.
MAX_SOURCES = 100_000


def word_count(text: "F.Column") -> "F.Column":
    """Number of maximal runs of characters other than space, TAB, LF, VT, FF, CR."""
    bare = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(bare, " "), lambda w: w != "")).cast("long")


def targets_for(sources: Sequence[tuple], weights: Sequence[float], max_copies: int, share: float = 1.0) -> list[float]:
    """Targets of sources given as (name, size), by repeating weights.

    Targets share ``share`` of all sizes by weight and stop at ``max_copies``
    times the source's size; the excess is shared anew among the others.
    """
    order = sorted(range(len(sources)), key=lambda i: (sources[i][0] is None, (sources[i][0] or "").encode("utf-32-be")))
    weight = {i: float(weights[k % len(weights)]) for k, i in enumerate(order)}
    left, free, out = share * sum(s for _, s in sources), set(weight), {}
    while free:
        total = sum(weight[i] for i in sorted(free))
        over = [i for i in sorted(free) if left * weight[i] / total > max_copies * sources[i][1]]
        if not over:
            out |= {i: left * weight[i] / total for i in free}
            break
        for i in over:
            out[i] = float(max_copies * sources[i][1])
            free.discard(i)
        left -= sum(out[i] for i in over)
    return [out[i] for i in range(len(sources))]


def solve_dual(histogram: DataFrame, targets: DataFrame, max_copies: int, iterations: int = 200, tolerance: float = 1e-9) -> dict:
    """Multipliers by distributed, safeguarded Newton steps.

    ``histogram``: source_key, size, n; ``targets``: source_key, source_size,
    source_docs, target.  Returns source_key -> lambda (one entry a source).
    Each iteration aggregates value and slope of the dual's gradient on the
    executors; bisection bounds keep the step where the cap flattens the slope.
    A source is solved within ``tolerance`` of its size, or where its bounds leave
    no number between them; what is still open after ``iterations`` raises.
    """
    spark = histogram.sparkSession
    info = {r["source_key"]: r for r in targets.collect()}  # one row a source
    lam = {k: 0.0 for k in info}
    low = {k: -np.inf for k in info}
    high = {k: np.inf for k in info}
    open_ = set()
    for k, r in info.items():
        if r["source_size"] == 0 or r["target"] <= 0:
            lam[k] = 0.0 if r["source_size"] == 0 else -np.inf
        elif r["target"] >= max_copies * r["source_size"] * (1 - 1e-12):
            lam[k] = np.inf
        else:
            open_.add(k)
    scaled = cut(histogram.join(F.broadcast(targets.select("source_key", (F.col("source_size") / F.col("source_docs")).alias("mean"))), "source_key").select(
        "source_key", (F.col("size") / F.col("mean")).alias("x"), "size", "n"
    ).where("size > 0").coalesce(8), "scaled")
    for number in range(iterations + 1):
        if not open_:
            break
        if number == iterations:
            raise RuntimeError(f"{len(open_)} sources unsolved after {iterations} Newton steps")
        now = driver_table(spark, [(k, float(lam[k])) for k in sorted(open_)], source_key=pa.int32(), lam=pa.float64())
        rate = F.least(F.exp(F.least(F.col("lam") * F.col("x"), F.lit(600.0))), F.lit(float(max_copies)))
        moved = scaled.join(F.broadcast(now), "source_key").select(
            "source_key", (F.col("size") * F.col("n") * rate).alias("value"),
            F.when(rate < max_copies, F.col("size") * F.col("n") * rate * F.col("x")).otherwise(0.0).alias("slope"),
        ).groupBy("source_key").agg(*[F.sum(F.col(c).cast("decimal(38,9)")).cast("double").alias(c) for c in ("value", "slope")])
        for k, value, slope in [tuple(r) for r in moved.collect()]:  # decimal sums: the same in any order
            gap = value - info[k]["target"]
            if abs(gap) <= tolerance * info[k]["source_size"]:
                open_.discard(k)
                continue
            (high if gap > 0 else low)[k] = lam[k]
            step = lam[k] - gap / slope if slope > 0 else np.inf
            if not low[k] < step < high[k]:
                if np.isfinite(low[k]) and np.isfinite(high[k]):
                    step = (low[k] + high[k]) / 2
                    if step in (low[k], high[k]):
                        open_.discard(k)
                else:
                    step = lam[k] + (1.0 if gap < 0 else -1.0) * max(1.0, abs(lam[k]))
            lam[k] = float(step)
    return lam


def round_sizes(sizes: np.ndarray, counts: np.ndarray, rates: np.ndarray, max_copies: int, target: float) -> np.ndarray:
    """Copies of every size of one source (descending sizes) with error feedback.

    A second pass from the largest size on spends what is still missing, or
    takes back what is too much, as far as whole copies allow.
    """
    copies, owed = np.zeros(len(sizes), np.int64), 0.0
    for i, (s, n, r) in enumerate(zip(sizes.tolist(), counts.tolist(), rates.tolist())):
        if s == 0:
            copies[i] = n
            continue
        owed += s * n * r
        m = min(max(round(owed / s), 0), max_copies * n)
        copies[i] = m
        owed -= m * s
    for i, (s, n) in enumerate(zip(sizes.tolist(), counts.tolist())):
        if s and abs(owed) >= s / 2:
            m = min(max(copies[i] + round(owed / s), 0), max_copies * n)
            owed -= (m - copies[i]) * s
            copies[i] = m
    return copies


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_copies: int = 3, share: float = 1.0, piece_rows: int = PIECE_ROWS, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, rate of every document.

    ``keep`` names further columns of ``docs`` to carry along, as ``_keep_<name>``.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *[F.col(c).alias(f"_keep_{c}") for c in keep])
    sized = cut(sized, "sizes", bool(keep))  # texts are read once
    by = cut(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "histogram")
    totals = cut(by.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("s"), F.sum("n").alias("n")), "sources")
    if (many := totals.count()) > MAX_SOURCES:
        raise ValueError(f"{many} sources; the dual is solved for {MAX_SOURCES} at most")
    sources = [tuple(r) for r in totals.collect()]
    sources.sort(key=lambda r: (r[0] is None, (r[0] or "").encode("utf-32-be")))
    goals = targets_for([(r[0], r[1]) for r in sources], weights, max_copies, share)
    spark = docs.sparkSession
    targets = driver_table(
        spark, [(i, r[0], r[1], r[2], float(t)) for i, (r, t) in enumerate(zip(sources, goals))],
        source_key=pa.int32(), source=pa.string(), source_size=pa.int64(), source_docs=pa.int64(), target=pa.float64(),
    )
    names = targets.select("source_key", F.col("source").alias("_source"))
    keyed = by.join(F.broadcast(names), F.col("source").eqNullSafe(F.col("_source"))).select("source_key", "size", "n")
    lam = solve_dual(keyed, targets, max_copies)
    solved = driver_table(spark, [(k, float(v)) for k, v in sorted(lam.items())], source_key=pa.int32(), lam=pa.float64())
    facts = targets.join(solved, "source_key")

    def copies_of(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("size", ascending=False)
        size, n = part["size"].to_numpy(), part["n"].to_numpy()
        mean = part["source_size"].iloc[0] / part["source_docs"].iloc[0]
        with np.errstate(over="ignore", invalid="ignore"):
            rate = np.minimum(np.exp(part["lam"].iloc[0] * size / mean) if mean else np.ones(len(size)), max_copies)
        rate[size == 0] = 1.0
        part["rate"] = rate
        part["total"] = round_sizes(size, n, rate, max_copies, part["target"].iloc[0])
        return part[["source_key", "size", "n", "rate", "total"]]

    rounded = keyed.join(F.broadcast(facts.drop("source")), "source_key").groupBy("source_key").applyInPandas(
        copies_of, "source_key int, size long, n long, rate double, total long"
    )
    plan = cut(
        rounded.join(F.broadcast(facts), "source_key").select(
            "source_key", "size", "n", "rate", "total", "source_size", "target",
            F.ceil(F.col("n") / F.lit(piece_rows)).cast("int").alias("_pieces"),
        ),
        "mixplan",
    )
    return _spend(sized, plan, targets, piece_rows, keep)


def _spend(sized: DataFrame, plan: DataFrame, targets: DataFrame, piece_rows: int, keep: Sequence[str]) -> DataFrame:
    """Give each document its copies: ``total`` of its (source, size) group over the group's ranks."""
    few = plan.count() <= BROADCAST_ROWS  # else the join shuffles, and Spark splits its hot keys
    at = (F.broadcast(plan) if few else plan).select("source_key", F.col("size").alias("_size"), "n", "rate", "total", "source_size", "target", "_pieces")
    names = targets.select("source_key", F.col("source").alias("_source"))
    ids = (
        sized.join(F.broadcast(names), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        .withColumn("_h", F.xxhash64("doc_id")).withColumnRenamed("source_key", "_key")
    )
    tagged = ids.join(at, (F.col("_key") == F.col("source_key")) & (F.col("size") == F.col("_size"))).drop("source_key", "_size").withColumn(
        "_piece", F.pmod("_h", F.col("_pieces")).cast("int")
    )
    group = ["_key", "size"]
    counted = tagged.where("_pieces > 1").groupBy(*group, "_piece").agg(F.count(F.lit(1)).alias("_m"))
    before = Window.partitionBy(*group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(counted.select(*group, "_piece", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_before")), "offsets")
    rank = F.row_number().over(Window.partitionBy(*group, "_piece").orderBy("_h", "doc_id"))
    base = F.floor(F.col("total") / F.col("n"))
    placed = tagged.join(offsets, [*group, "_piece"], "left").withColumn("_rank", rank + F.coalesce("_before", F.lit(0)))
    copies = (base + (F.col("_rank") <= F.col("total") - base * F.col("n")).cast("long")).cast("int")
    return placed.select(
        "doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"),
        copies.alias("copies"), "rate", *[F.col(f"_keep_{c}") for c in keep],
    )


def mixed(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_copies: int = 3, share: float = 1.0) -> DataFrame:
    """``docs`` with every row as often as the mix takes it (rows without copies go); whole rows are not shuffled."""
    rows = numbered(docs)
    sized = rows.select(F.col("_id").alias("doc_id"), F.col("_doc.source").alias("source"), "text", "_row")
    copies = mix(sized, weights, max_copies, share, keep=["_row"]).select(F.col("_keep__row").alias("_row"), "copies")
    return repeated(rows, copies, max_copies).select(*[F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])
