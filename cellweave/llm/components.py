"""Connected components of a link table, without collecting links.

Alternating large-star and small-star rounds until the links stop changing;
each round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import remove, scratch


#: A node's links are spread over so many join keys.
SALTS = 16


def _with_least(links: DataFrame) -> DataFrame:
    """``links`` (u, v) with ``m``, the smallest v of each u, joined per (u, salt): no node's links meet in one task."""
    salted = links.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy("u", "s").agg(F.min("v").alias("m"))
    least = parts.groupBy("u").agg(F.min("m").alias("m"), F.collect_list("s").alias("s"))  # at most SALTS entries
    return salted.join(least.select("u", "m", F.explode("s").alias("s")), ["u", "s"]).select("u", "v", "m")


def _round(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    down = _with_least(large)
    # A node's link to its least neighbour, and its other neighbours' links to that one.
    return down.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()


def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """node, component (smallest node reachable) for every node of ``links`` (a, b long).

    Loops and repeated links are ignored; a node that only links to itself is
    not returned.
    """
    spark = links.sparkSession
    start = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    path = scratch(spark, "links")
    start.write.parquet(path)
    kind = start.schema
    now = spark.read.schema(kind).parquet(path)
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = mark(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        after = scratch(spark, "links")
        _round(now).write.parquet(after)
        new = spark.read.schema(kind).parquet(after)
        found = mark(new)
        remove(spark, path)
        path, now = after, new
        if found == seen:
            break
        seen = found
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def label_rows(rows: DataFrame, key: str, labels: DataFrame, label: str) -> DataFrame:
    """Join ``labels`` (key, label; one row a key) to ``rows`` that carry ``_salt``.

    The join key is (key, salt), with exactly the salts that occur in ``rows``,
    so a key that holds a large share of the rows is spread over many tasks.
    """
    salts = rows.select(key, "_salt").distinct()
    spread = salts.join(labels.select(key, label), key)
    return rows.join(spread, [key, "_salt"])


