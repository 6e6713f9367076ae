"""Height files of unknown kind: PNG by its signature, anything else headerless 16-bit samples.

Raw samples carry neither size nor byte order.  A size that is not given follows from the number of samples (from one side,
or a square); ``auto`` takes the order in which neighbouring samples step less, each against its own extent, ties little-endian.
Empty files, an odd number of bytes (but for the line separator of the sink that wrote the file) and sizes that the samples
do not fill raise ``PngError``.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.sources.png import SIGNATURE, PngError, decode
from cellweave.sources.raw16 import FULL

ORDERS = {"little": "<u2", "big": ">u2"}


def byte_order(raw: bytes) -> str:
    """The byte order in which the samples of ``raw`` are smoother."""

    def roughness(kind: str) -> float:
        values = np.frombuffer(raw[: len(raw) // 2 * 2], kind).astype(np.int64)
        return float(abs(np.diff(values)).sum()) / max(1, int(np.ptp(values))) if len(values) > 1 else 0.0

    return "big" if roughness(ORDERS["big"]) < roughness(ORDERS["little"]) else "little"


def sides(samples: int, width: int | None = None, height: int | None = None) -> tuple[int, int]:
    """(width, height) that ``samples`` fill."""
    if width is None and height is None:
        width = isqrt(samples)
    width = samples // height if width is None else width
    height = samples // max(1, width) if height is None else height
    if width < 1 or height < 1 or width * height != samples:
        raise PngError(f"{samples} raw samples do not fill {width} x {height}: give the width and height")
    return width, height


def heights(content: bytes, width: int | None = None, height: int | None = None, order: str = "little") -> np.ndarray:
    """(height, width) of values from 0 to 1; of a PNG the first channel."""
    if content[: len(SIGNATURE)] == SIGNATURE:
        image = decode(content)
        return image[:, :, 0] / float(np.iinfo(image.dtype).max)
    if len(content) % 2 and content.endswith(b"\n"):
        content = content[:-1]
    if not content or len(content) % 2:
        raise PngError(f"neither a PNG nor 16-bit samples: {len(content)} bytes")
    width, height = sides(len(content) // 2, width, height)
    kind = ORDERS[byte_order(content) if order == "auto" else order]
    return np.frombuffer(content, kind).reshape(height, width) / float(FULL)


def write_raw(cells: DataFrame, path: str, low: float, high: float, order: str = "little") -> None:
    """Each raster of ``cells`` (map_id, x, z, v) as a file of 16-bit samples, row by row."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["z", "x"])
        raw = np.clip(np.floor((part["v"].to_numpy() - low) / (high - low) * FULL + 0.5), 0, FULL).astype(ORDERS[order])
        return pd.DataFrame({"map_id": part["map_id"].iloc[:1], "image": [raw.tobytes()]})

    files = cells.select(F.col("map_id").cast("long").alias("map_id"), "x", "z", "v").groupBy("map_id").applyInPandas(pack, "map_id long, image binary")
    files.select("map_id", F.expr("cast(image as string)").alias("value")).write.partitionBy("map_id").option("maxRecordsPerFile", 1).text(path)


def read_heights(spark: SparkSession, path: str, low: float, high: float, width: int | None = None, height: int | None = None, order: str = "auto") -> DataFrame:
    """map_id, x, z, v of the height files below ``path``, of either kind."""

    def unpack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for map_id, content in zip(part["map_id"], part["content"]):
                values = heights(content, width, height, order)
                z, x = np.indices(values.shape).reshape(2, -1)
                yield pd.DataFrame({"map_id": map_id, "x": x, "z": z, "v": low + values.ravel() * (high - low)})

    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "map_id=(-?[0-9]+)", 1).cast("long").alias("map_id"), "content")
    return files.mapInPandas(unpack, "map_id long, x long, z long, v double")
