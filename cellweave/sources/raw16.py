"""Headerless 16-bit height rows, little-endian, in files that Spark reads and writes.

A file holds whole rows of one raster; its name orders it (``z`` of the first
row).  Written through the text sink, one file a block of rows: the sink's line
separator ends each file, so readers drop one trailing byte.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cellweave.operators.grid import Grid, GridMeta
from cellweave.operators.regions import DEFAULT_CHECKPOINTS

#: Full scale of raw heights in exchange files.
FULL = 65535
BLOCK_ROWS = 256


def scratch(spark: SparkSession, name: str) -> str:
    """A path, used once, in the folder that driver and executors share (a folder of our own only in local mode)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(named or DEFAULT_CHECKPOINTS).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_raw16(grid: Grid, path: str, low: float, high: float, block_rows: int = BLOCK_ROWS) -> None:
    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["z", "x"])
        raw = np.clip(np.floor((part["v"].to_numpy() - low) / (high - low) * FULL + 0.5), 0, FULL).astype("<u2")
        first = int(part["z"].iloc[0])
        return pd.DataFrame({"z0": [first], "image": [raw.tobytes()]})

    blocks = grid.df.select(F.floor(F.col("z") / block_rows).alias("block"), "x", "z", "v").groupBy("block").applyInPandas(pack, "z0 long, image binary")
    blocks.select("z0", F.expr("cast(image as string)").alias("value")).write.partitionBy("z0").option("maxRecordsPerFile", 1).text(path)


def read_raw16(spark: SparkSession, path: str, width: int, low: float, high: float) -> Grid:
    def unpack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for z0, content in zip(part["z0"], part["content"]):
                raw = np.frombuffer(content[: len(content) // 2 * 2], "<u2").astype(float)
                at = np.arange(len(raw))
                yield pd.DataFrame({"x": at % width, "z": z0 + at // width, "v": low + raw / FULL * (high - low)})

    files = spark.read.format("binaryFile").load(path).select(F.col("z0").cast("long").alias("z0"), "content")
    df = files.mapInPandas(unpack, "x long, z long, v double")
    height = df.agg(F.max("z") + 1).first()[0] or 0
    return Grid(df, GridMeta(width, int(height)))
