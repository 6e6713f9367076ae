"""PNG images: an encoder and decoder, and 16-bit grey height files that Spark reads and writes.

Decoded are 8 and 16 bits a sample in 1 to 4 channels, all five row filters, without interlacing; checksums are verified.
Files are written through the text sink, one file a raster, whose line separator follows the last chunk; bytes there are ignored.
A raster is one file, so it is packed by one task: ``MOST`` samples at most.  An empty table writes no file; a raster with
missing cells or null heights raises; columns other than map_id, x, z, v are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.sources.raw16 import FULL

# Fixed values of the format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
COLOUR_TYPES = {1: 0, 2: 4, 3: 2, 4: 6}
NONE, SUB, UP, AVERAGE, PAETH = range(5)

#: Samples of a raster.
MOST = 1 << 26


class PngError(ValueError):
    """A file that is no PNG, is damaged, or is of a kind that is not read."""


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _predicted(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """What filter ``kind`` subtracts from the bytes of ``row``."""
    back = lambda r: np.concatenate([np.zeros(step, np.int32), r[:-step]])
    left, corner = back(row), back(above)
    if kind == PAETH:
        guess = left + above - corner
        a, b, c = abs(guess - left), abs(guess - above), abs(guess - corner)
        return np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))
    return {NONE: np.zeros_like(row), SUB: left, UP: above, AVERAGE: (left + above) >> 1}[kind]


def encode(image: np.ndarray, level: int = 6, kinds: tuple[int, ...] = (NONE, SUB, UP, AVERAGE, PAETH)) -> bytes:
    """``image`` (height, width[, channels]) of uint8 or uint16; each row by the filter of ``kinds`` with the least sum of signed bytes."""
    image = image[:, :, None] if image.ndim == 2 else image
    height, width, channels = image.shape
    if not height or not width or channels not in COLOUR_TYPES or image.dtype not in (np.uint8, np.uint16):
        raise PngError(f"no PNG holds {image.dtype} samples in the shape {image.shape}")
    step = channels * image.dtype.itemsize
    rows = np.frombuffer(image.astype(image.dtype.newbyteorder(">")).tobytes(), np.uint8).reshape(height, -1).astype(np.int32)
    above, lines = np.zeros(width * step, np.int32), []
    for row in rows:
        tried = {k: (row - _predicted(k, row, above, step) & 255).astype(np.uint8) for k in kinds}
        best = min(kinds, key=lambda k: int(abs(tried[k].view(np.int8).astype(np.int32)).sum()))
        lines.append(bytes([best]) + tried[best].tobytes())
        above = row
    head = struct.pack(">IIBBBBB", width, height, 8 * image.dtype.itemsize, COLOUR_TYPES[channels], 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(b"".join(lines), level)) + _chunk(b"IEND", b"")


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    if data[:8] != SIGNATURE:
        raise PngError("not a PNG")
    at = 8
    while True:
        if at + 12 > len(data):
            raise PngError("cut short")
        size = int.from_bytes(data[at : at + 4], "big")
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body).to_bytes(4, "big") != data[at + 8 + size : at + 12 + size]:
            raise PngError(f"chunk {kind!r} is damaged")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + size


def _restored(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """The bytes of a filtered row."""
    if kind == NONE:
        return line
    if kind == UP:
        return line + above & 255
    if kind == SUB:
        return (np.cumsum(line.reshape(-1, step), axis=0) & 255).reshape(-1)
    out, up = [0] * step + line.tolist(), [0] * step + above.tolist()
    for i in range(step, len(out)):  # each byte needs the one before it
        a, b, c = out[i - step], up[i], up[i - step]
        if kind == PAETH:
            p, q, r = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = a if p <= q and p <= r else b if q <= r else c
        else:
            guess = (a + b) >> 1
        out[i] = out[i] + guess & 255
    return np.array(out[step:], np.int32)


def decode(data: bytes) -> np.ndarray:
    """(height, width, channels) of uint8 or uint16."""
    head, packed = None, []
    for kind, body in _chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind not in (b"IEND", b"PLTE") and not kind[0] & 32:
            raise PngError(f"critical chunk {kind!r} is not read")
    if head is None:
        raise PngError("no header")
    width, height, bits, colour, _, _, interlaced = head
    channels = {c: n for n, c in COLOUR_TYPES.items()}.get(colour)
    if not width or not height or bits not in (8, 16) or channels is None or interlaced:
        raise PngError(f"not read: {bits} bits, colour type {colour}, interlacing {interlaced}, {width} x {height}")
    step = channels * bits // 8
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    except zlib.error as e:
        raise PngError(str(e)) from e
    if len(raw) != height * (width * step + 1) or raw[:: width * step + 1].max() > PAETH:
        raise PngError("rows do not match the header")
    rows, above = [], np.zeros(width * step, np.int32)
    for line in raw.reshape(height, -1):
        above = _restored(int(line[0]), line[1:].astype(np.int32), above, step)
        rows.append(above.astype(np.uint8).tobytes())
    return np.frombuffer(b"".join(rows), ">u2" if bits == 16 else "u1").astype(np.uint16 if bits == 16 else np.uint8).reshape(height, width, channels)


def write_png16(cells: DataFrame, path: str, low: float, high: float) -> None:
    """Each raster of ``cells`` (map_id, x, z, v) as a 16-bit grey PNG; ``low`` to ``high`` is 0 to full scale."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        width, height = int(part["x"].max()) + 1, int(part["z"].max()) + 1
        if width * height != len(part) or part["v"].isna().any() or len(part) > MOST:
            raise PngError(f"raster of {len(part)} cells does not fill {width} x {height}, or exceeds {MOST}")
        image = np.empty((height, width), np.uint16)
        image[part["z"], part["x"]] = np.clip(np.floor((part["v"].to_numpy() - low) / (high - low) * FULL + 0.5), 0, FULL)
        return pd.DataFrame({"map_id": part["map_id"].iloc[:1], "image": [encode(image)]})

    files = cells.select(F.col("map_id").cast("long").alias("map_id"), "x", "z", "v").groupBy("map_id").applyInPandas(pack, "map_id long, image binary")
    files.select("map_id", F.expr("cast(image as string)").alias("value")).write.partitionBy("map_id").option("maxRecordsPerFile", 1).text(path)


def read_png16(spark: SparkSession, path: str, low: float, high: float) -> DataFrame:
    """map_id, x, z, v of the files below ``path``; the first channel of 8 or 16 bits."""

    def unpack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for map_id, content in zip(part["map_id"], part["content"]):
                image = decode(content)[:, :, 0]
                z, x = np.indices(image.shape).reshape(2, -1)
                yield pd.DataFrame({"map_id": map_id, "x": x, "z": z, "v": low + image.ravel() / float(np.iinfo(image.dtype).max) * (high - low)})

    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "map_id=(-?[0-9]+)", 1).cast("long").alias("map_id"), "content")
    return files.mapInPandas(unpack, "map_id long, x long, z long, v double")
