"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder (tests, laptops).
DEFAULT_SHARED = "/tmp/checkpoints/cellweave"
#: Arrow batches of large values: rows and bytes, each held by the JVM and by Python, more than once while it is copied;
#: and the rows that a Parquet reader holds at once.
SMALL = {"spark.sql.execution.arrow.maxRecordsPerBatch": 512, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20, "spark.sql.parquet.columnarReaderBatchSize": 512}

#: Words of 64 row numbers that are broadcast, about 50 bytes each.
BROADCAST_WORDS = 1 << 19


#: What a Python worker keeps between tasks: one value, such as an encoder with its memo.
_KEPT: dict = {}


def kept(key: tuple, make: Callable[[], object]) -> object:
    """The value of ``make()``, once a Python worker for as long as its tasks ask for the same key."""
    if key not in _KEPT:
        forget()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Drop what an earlier job left in this Python worker; tasks that keep nothing begin with it."""
    _KEPT.clear()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):  # glibc's
        libc.malloc_trim(0)


def driver_table(spark: SparkSession, rows: list[tuple], **kinds: pa.DataType) -> DataFrame:
    """A few ``rows`` of the driver as a table; goes by Arrow, as lists of tuples start Python workers that only copy them."""
    columns = list(zip(*rows)) or [()] * len(kinds)
    return spark.createDataFrame(pa.table([pa.array(c, k) for c, k in zip(columns, kinds.values())], names=list(kinds)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` of the session; where that is unset, a folder of
    our own is set as checkpoint directory first.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(DEFAULT_SHARED)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path, used once, below the shared folder."""
    return f"{shared_dir(spark)}/cellweave-{name}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession, limits: dict[str, int]) -> Iterator[None]:
    """While it lasts, started queries send Arrow batches within ``limits`` to Python; the session's own limits come back."""
    were = {k: spark.conf.get(k, None) for k in limits}
    for k, v in limits.items():
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in were.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage: what was computed survives the loss of any executor and
    is computed once, however often the result is read.  ``small``: whole texts
    or sets are read or go to Python, in batches that hold few of them at once.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    with small_batches(spark, SMALL if small else {}):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = [path]
    return out


def drop(*tables: DataFrame) -> None:
    """Delete what was written for tables of ``cut``, ``numbered`` and ``first_rows``, when nothing is left that reads them."""
    for table in tables:
        for path in table._scratch:
            remove(table.sparkSession, path)


def within(rows: DataFrame, ids: DataFrame, column: str = "_row") -> DataFrame:
    """The ``rows`` whose ``column`` is among ``ids`` (one column of longs, not null); ``rows`` are not shuffled.

    The ids go out as words of 64 bits, so a broadcast has a row for each 64
    numbers of ``numbered`` at most; beyond ``BROADCAST_WORDS`` a join shuffles.
    """
    id = F.col(ids.columns[0])
    words = cut(ids.groupBy(F.shiftright(id, 6).alias("_word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({ids.columns[0]} & 63 as int))")).alias("_bits")), "ids")
    words_of = F.broadcast(words) if words.count() <= BROADCAST_WORDS else words
    bit = F.expr(f"shiftrightunsigned(_bits, cast({column} & 63 as int)) & 1")
    out = rows.withColumn("_word", F.shiftright(column, 6)).join(words_of, "_word").where(bit == 1).select(*rows.columns)
    out._scratch = words._scratch
    return out


def repeated(rows: DataFrame, copies: DataFrame, most: int) -> DataFrame:
    """The ``rows``, each as often as ``copies`` (_row, copies: ``most`` or fewer, none twice) says; ``rows`` are not shuffled.

    Each binary digit of the copies goes out as the ids of ``within`` do.
    """
    digits = range(max(1, most.bit_length()))
    bits = [F.bit_or(F.expr(f"shiftleft(cast(shiftright(copies, {d}) & 1 as bigint), cast(_row & 63 as int))")).alias(f"_bits{d}") for d in digits]
    words = cut(copies.where("copies > 0").groupBy(F.shiftright("_row", 6).alias("_word")).agg(*bits), "copies")
    words_of = F.broadcast(words) if words.count() * len(digits) <= BROADCAST_WORDS else words
    many = F.expr(" + ".join(f"cast(shiftrightunsigned(_bits{d}, cast(_row & 63 as int)) & 1 as int) * {1 << d}" for d in digits))
    counted = rows.withColumn("_word", F.shiftright("_row", 6)).join(words_of, "_word").withColumn("_copies", many).where("_copies > 0")
    return counted.select(*rows.columns, F.explode(F.sequence(F.lit(1), "_copies")).alias("_copy")).drop("_copy")


def numbered(docs: DataFrame) -> DataFrame:
    """_row, text, _id (doc_id), _doc (all columns of a row of ``docs``); the rows are written once, so that numbers stay."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    kept = cut(docs.select(F.monotonically_increasing_id().alias("_row"), whole.alias("_doc")), "numbered", True)
    rows = kept.select("_row", F.col("_doc.text").alias("text"), F.col("_doc.doc_id").alias("_id"), "_doc")
    rows._scratch = kept._scratch
    return rows


def first_rows(rows: DataFrame, groups: DataFrame, columns: list[str]) -> DataFrame:
    """Of each component of ``groups`` (_row, component) the first of ``rows`` (see ``numbered``), as it was.

    First by (null id last, id, hash of the text, hash of the row), so that reruns agree however rows are dealt.
    """
    content = F.to_json("_doc") if "map<" in rows.schema["_doc"].dataType.simpleString() else F.col("_doc")  # maps have no hash
    order = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.xxhash64("text").alias("text"), F.xxhash64(content).alias("doc"), "_row")
    named = rows.select("_row", order.alias("first")).join(groups, "_row")
    stay = cut(named.groupBy("component").agg(F.min("first").alias("first")).select("first._row"), "stay")
    kept = within(rows, stay)
    out = kept.select(*[F.col(f"_doc.`{c}`").alias(c) for c in columns])
    out._scratch = [*rows._scratch, *kept._scratch]
    drop(stay)
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path on whatever file system holds it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def write_blobs(df: DataFrame, column: str, path: str) -> None:
    """Write each binary value of ``column`` as one file of exactly its bytes.

    Goes through Spark's own committer (any Hadoop file system, safe against
    lost and speculative tasks).  The text sink ends every file with its line
    separator, so each value must end in a newline, which the sink then writes.
    """
    (
        df.select(F.expr(f"cast(substring({column}, 1, length({column}) - 1) as string)").alias("value"))
        .write.option("maxRecordsPerFile", 1)
        .text(path)
    )


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """Files below ``path`` as (path, length, content)."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def crc_fold(column: str, modulus: int) -> "F.Column":
    """crc32 of an id written in decimal, modulo ``modulus`` (null id: null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)
