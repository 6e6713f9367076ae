"""The registered queries ``opN_<name>`` and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm import bpe, cws, hmm, langid, mixing, nndescent, simhash, sstable, urlfilter, warc
from cellweave.llm.common import table

#: The rules that op9 judges by: action, host, path.
URL_RULES = [
    urlfilter.Rule("block", "com", "/en/"),
    urlfilter.Rule("allow", "example.com", "/en/7"),
    urlfilter.Rule("allow", "net", "/de/"),
    urlfilter.Rule("block", "example.net", "/de/8"),
    urlfilter.Rule("block", "org", "/es/"),
]


#: The folder of the public tokenizers' files, where it is not the installed one.
TOKENIZERS = "CELLWEAVE_TOKENIZERS"


def tokenizer_path(name: str) -> str:
    if folder := os.environ.get(TOKENIZERS):
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.digest(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), 2)


def op2_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.near_duplicates(table(spark, sf_dir, "embeddings"), 0.95)


def op4_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"))


def op5_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, radius=4)


def op7_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cws.edits(table(spark, sf_dir, "documents"))


def op8_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op6_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(table(spark, sf_dir, "pages"))


def op9_url_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op10_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), (5, 2, 1), 3).select(
        "doc_id", "size", "source_size", "target", "taken", "copies", "rate"
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sstable": op1_sstable,
        "op2_language_mixture": op2_language_mixture,
        "op3_nn_descent": op3_nn_descent,
        "op4_hidden_markov": op4_hidden_markov,
        "op5_simhash_bktree": op5_simhash_bktree,
        "op6_warc_transactions": op6_warc_transactions,
        "op7_weighted_sampling": op7_weighted_sampling,
        "op8_bpe_transducer": op8_bpe_transducer,
        "op9_url_trie": op9_url_trie,
        "op10_entropy_mixing": op10_entropy_mixing,
    }


SQL_OP6 = """
WITH rows_ AS (
  SELECT page_id, coalesce(html, '') AS body, upper(sha1(coalesce(html, ''))) AS hex FROM pages
), digits AS (
  SELECT page_id, body, hex,
         list_transform(range(32), lambda i: (('0x' || substr(hex, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31) AS d
  FROM rows_
)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
       array_to_string(list_transform(d, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x::INT + 1, 1)), '') AS payload_digest,
       CASE WHEN min(page_id) OVER (PARTITION BY body) < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN min(page_id) OVER (PARTITION BY body) < page_id THEN min(page_id) OVER (PARTITION BY body) END AS refers_to
FROM digits
"""

SQL_OP9 = r"""
WITH parts AS (
  SELECT page_id, strpos(url, '://') AS mark, url FROM pages
), rest AS (
  SELECT page_id, CASE WHEN mark > 0 THEN substr(url, mark + 3) ELSE '' END AS tail FROM parts
), split AS (
  SELECT page_id,
         translate(regexp_extract(tail, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), rules(action, rhost, rpath) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
         ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), fits AS (
  SELECT page_id, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(action, length(rhost || rpath)) AS action
  FROM split JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id
)
SELECT s.page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(action, 'allow') AS verdict
FROM split s LEFT JOIN fits f ON s.page_id = f.page_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_warc_transactions": SQL_OP6, "op9_url_trie": SQL_OP9}
