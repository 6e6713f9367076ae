"""URL rules in a trie over reversed host labels and path segments.

A rule is an action (``allow`` or ``block``), a host and a path.  It fits its
host and every subdomain, where the url's path starts with the rule's.  Of the
rules that fit, the longest wins: most host labels, then longest path; of equal
rules, ``block`` wins.  Urls that no rule fits get the default verdict.

The trie goes to the executors as one broadcast value.  Its size is bounded by
``max_rules`` and ``max_bytes``; a larger list raises unless ``large="join"`` is
given, which answers by an equi-join on host suffixes instead (same results).

Defined cases: a null url, or one without ``://``, has empty host and path and
so fits no rule; a rule with an empty host fits every host that is not empty;
repeated urls are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_RULES = 2_000_000
MAX_BYTES = 256 << 20

#: Hosts are lower-cased in A-Z only.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
ASCII_LOWER = str.maketrans(UPPER, LOWER)
URL = re.compile(r"^(?:.*?)://([^/?#]*)([^?#]*)", re.S)


class Rule(NamedTuple):
    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


class Node:
    """A trie node: children by whole label or segment, rules by unfinished tail."""

    __slots__ = ("labels", "segments", "tails")

    def __init__(self) -> None:
        self.labels: dict[str, Node] = {}
        self.segments: dict[str, Node] = {}
        self.tails: dict[str, tuple[str, str]] = {}


def split_url(url: str | None) -> tuple[str, str]:
    found = URL.match(url) if url is not None else None
    return (found[1].translate(ASCII_LOWER), found[2]) if found else ("", "")


def build_trie(rules: Sequence[Rule]) -> Node:
    root = Node()
    for rule in rules:
        node = root
        for label in reversed(rule.host.translate(ASCII_LOWER).split(".")) if rule.host else ():
            node = node.labels.setdefault(label, Node())
        *whole, tail = rule.path.split("/")
        for segment in whole:
            node = node.segments.setdefault(segment, Node())
        held = node.tails.get(tail)
        if held is None or held[0] == "allow":
            node.tails[tail] = (rule.action, rule.text)
    return root


def _best_path(node: Node, segments: list[str]) -> tuple[str, str] | None:
    best, last = None, len(segments) - 1
    for at, segment in enumerate(segments):
        if node.tails:
            for size in range(len(segment), -1, -1):
                if (held := node.tails.get(segment[:size])) is not None:
                    best = held
                    break
        if at == last or (node := node.segments.get(segment)) is None:
            break
    return best


def look_up(root: Node, host: str, path: str) -> tuple[str, str] | None:
    """(action, rule text) of the longest rule that fits, or None."""
    if not host:
        return None
    segments, node, best = path.split("/"), root, None
    if found := _best_path(root, segments):
        best = found
    for label in reversed(host.split(".")):
        node = node.labels.get(label)
        if node is None:
            break
        if node.segments or node.tails:
            best = _best_path(node, segments) or best
    return best


def judge(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", large: str = "raise", max_rules: int = MAX_RULES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages`` (page_id, url)."""
    rules = [Rule(*r) for r in rules]
    if len(rules) > max_rules or sum(len(r.text) + 64 for r in rules) > max_bytes:
        if large == "join":
            return judge_by_join(pages, rules, default)
        raise ValueError(f"{len(rules)} rules are more than a broadcast trie may hold; pass large='join'")
    shared = pages.sparkSession.sparkContext.broadcast(build_trie(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        for batch in batches:
            hosts, paths, texts, verdicts = [], [], [], []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                found = look_up(trie, host, path)
                hosts.append(host)
                paths.append(path)
                texts.append(found[1] if found else None)
                verdicts.append(found[0] if found else default)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.string()) for x in (hosts, paths, texts, verdicts))],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url").mapInArrow(
        run, f"page_id {kind}, host string, path string, rule string, verdict string"
    )


def judge_by_join(pages: DataFrame, rules: Sequence[Rule] | DataFrame, default: str = "allow") -> DataFrame:
    """The same for rule lists of any size: join on (host suffix), keep the longest."""
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([tuple(r) for r in rules], "action string, host string, path string")
    split = pages.select(
        "page_id",
        F.translate(F.coalesce(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER).alias("host"),
        F.coalesce(F.regexp_extract("url", r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit("")).alias("path"),
        F.monotonically_increasing_id().alias("_row"),
    )
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    sides = split.select("*", F.explode(F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.concat(suffixes, F.array(F.lit(""))))).alias("_suffix"))
    right = rules.select(
        F.translate("host", UPPER, LOWER).alias("_suffix"), F.col("path").alias("_path"), "action",
        F.concat("host", "path").alias("rule"),
    )
    rank = F.struct(
        F.when(F.col("_suffix") == "", 0).otherwise(F.size(F.split("_suffix", r"\."))).alias("labels"),
        F.length("_path").alias("size"), (F.col("action") == "block").alias("block"),
        F.col("rule"), F.col("action"),
    )
    best = (
        sides.join(right, "_suffix").where(F.startswith("path", "_path"))
        .groupBy("_row").agg(F.max(rank).alias("_best"))
    )
    return split.join(best, "_row", "left").select(
        "page_id", "host", "path", F.col("_best.rule").alias("rule"),
        F.coalesce("_best.action", F.lit(default)).alias("verdict"),
    )
