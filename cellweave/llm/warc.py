"""WARC archives: write, read back, assemble transactions.

Every capture becomes three records: a request, a response (or a revisit of an
earlier response with the same payload) and a metadata record.  Request and
metadata name the capture's main record in ``WARC-Concurrent-To``.

* ``archive_records`` renders the records as text (native expressions only),
* ``write_archives`` writes them as gzipped archives through Spark's text
  sink: a record ends in CRLF CRLF, which is the sink's line separator, so the
  files are exact WARC 1.1,
* ``read_archives`` parses archives of any writer by ``Content-Length``,
* ``assemble`` joins the records through their concurrent-to identifiers into
  one nested row per capture.

Defined cases: a null payload is an empty one; empty payloads are equal to each
other; a null url is written as an empty target; a null or repeated capture id
is kept (captures are told apart by a record number that is unique per row);
an empty table gives no archive and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.llm.common import cut, read_blobs, scratch

#: Fixed values of the format.
CRLF = "\r\n"
HEX32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ZERO_DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Records of equal payloads are spread over so many join keys.
SALTS = 64
#: Archives hold at most so many records, so that one archive fits a task.
RECORDS_PER_FILE = 3000
#: Archives are inflated by so many bytes.
PIECE_BYTES = 1 << 20

RECORD = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("concurrent_to", T.StringType()),
        T.StructField("refers_to_record", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("capture_id", T.LongType()),
        T.StructField("refers_to_capture", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("digest_ok", T.BooleanType()),
        T.StructField("body", T.BinaryType()),
    ]
)


def base32_sha1(column: "F.Column") -> "F.Column":
    """SHA-1 of a string's UTF-8 bytes in upper-case base32, in expressions only."""
    digest = F.sha1(column.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), HEX32, BASE32)


def with_first_capture(pages: DataFrame, min_bytes: int = 0, salts: int = SALTS) -> DataFrame:
    """Mark which rows repeat an earlier payload.

    Adds ``payload_bytes``, ``payload_digest``, ``_row`` (a number of the row),
    ``first_id``, the smallest capture id with this payload, and ``first_row``, its row.  Only payloads that repeat are looked up; their
    keys are written first, so Spark knows their size and broadcasts them when
    that is below its threshold, else joins by shuffle.  A hot payload is counted
    and joined per (digest, salt), so no task meets all its rows.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        "page_id",
        "url",
        body.alias("html"),
        F.octet_length(body).cast("long").alias("payload_bytes"),
        base32_sha1(body).alias("payload_digest"),
        F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int").alias("_salt"),
        F.monotonically_increasing_id().alias("_row"),
    )
    keyed = rows.where(F.col("payload_bytes") >= min_bytes).select("payload_digest", "_salt", F.struct(F.col("page_id").isNull().alias("none"), "page_id", "_row").alias("_capture"))
    salted = keyed.groupBy("payload_digest", "_salt").agg(F.min("_capture").alias("_least"), F.count(F.lit(1)).alias("_m"))
    whole = salted.groupBy("payload_digest").agg(
        F.min("_least").alias("_first"), F.sum("_m").alias("_n"), F.collect_list("_salt").alias("_salts")
    ).where("_n > 1")  # at most ``salts`` entries a digest
    keys = cut(whole.select("payload_digest", F.col("_first.page_id").alias("first_id"), F.col("_first._row").alias("first_row"), F.explode("_salts").alias("_salt")), "repeats")
    return rows.join(keys, ["payload_digest", "_salt"], "left").drop("_salt")


def archive_records(marked: DataFrame) -> DataFrame:
    """One text value per record: request, response or revisit, metadata."""
    def uid(page: str, row: str) -> "F.Column":
        return F.sha1(F.concat_ws("/", F.coalesce(F.col(page).cast("string"), F.lit("-")), F.col(row).cast("string")))

    def urn(kind: str, of: "F.Column" = uid("page_id", "_row")) -> "F.Column":
        return F.concat(F.lit(f"<urn:{kind}:"), of, F.lit(">"))

    def record(kind: "F.Column", rid: "F.Column", extra: list, media: str, body: "F.Column") -> "F.Column":
        lines = [
            F.lit("WARC/1.1"),
            F.concat(F.lit("WARC-Type: "), kind),
            F.concat(F.lit("WARC-Record-ID: "), rid),
            F.lit(f"WARC-Date: {ZERO_DATE}"),
            F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]", "")),
            *extra,
            F.lit(f"Content-Type: {media}"),
            F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
        ]
        return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), body)

    again = F.col("first_id").isNotNull() & (F.col("first_id") != F.col("page_id"))
    kind = F.when(again, F.lit("revisit")).otherwise(F.lit("response"))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest"))
    refers = F.when(again, F.concat(F.lit("WARC-Refers-To: "), urn("main", uid("first_id", "first_row"))))
    capture = F.when(again, F.concat(F.lit("X-Refers-To-Capture: "), F.col("first_id").cast("string")))
    profile = F.when(again, F.lit(f"WARC-Profile: {REVISIT_PROFILE}"))
    length = F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes").cast("string"))
    http = F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}")
    main = record(
        kind, urn("main"), [digest, length, refers, capture, profile], "application/http; msgtype=response",
        F.concat(http, F.when(again, F.lit("")).otherwise(F.col("html"))),
    )
    concurrent = F.concat(F.lit("WARC-Concurrent-To: "), urn("main"))
    ask = record(
        F.lit("request"), urn("request"), [concurrent], "application/http; msgtype=request",
        F.lit(f"GET / HTTP/1.1{CRLF}{CRLF}"),
    )
    about = record(
        F.lit("metadata"), urn("metadata"), [concurrent], "application/warc-fields",
        F.concat(F.lit("capture: "), F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.lit(CRLF)),
    )
    return marked.select(F.explode(F.array(ask, main, about)).alias("value"))


def write_archives(records: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    records.write.option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", records_per_file).option("compression", "gzip").text(path)


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    return out


def inflate(data: bytes) -> Iterator[bytes]:
    """An archive's bytes piece by piece: plain, or gzip of one or many members."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data:
        member, rest = zlib.decompressobj(31), data
        while not member.eof:
            piece = member.decompress(rest, PIECE_BYTES)
            rest = member.unconsumed_tail
            if not piece and not rest and not member.eof:
                raise ValueError("an archive is cut short")
            yield piece
        data = member.unused_data


def parse_archive(data: bytes) -> Iterator[tuple]:
    """Rows of ``RECORD`` from one archive's bytes, inflated as they are needed; raises on a broken record."""
    pieces, held, at, done = inflate(data), bytearray(), 0, 0

    def more() -> bool:
        piece = next(pieces, None)
        held.extend(piece or b"")
        return piece is not None

    while True:
        if at > PIECE_BYTES:
            del held[:at]
            done, at = done + at, 0
        while (stop := held.find(b"\r\n\r\n", at)) < 0:
            if not more():
                break
        if stop < 0 and at >= len(held):
            return
        if stop < 0 or not held.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {done + at}")
        f = _fields(bytes(held[at:stop]))
        size = int(f["content-length"])
        while len(held) < stop + 8 + size and more():
            pass
        body = bytes(held[stop + 4 : stop + 4 + size])
        if len(body) != size:
            raise ValueError(f"record at byte {done + at} is cut short")
        at = min(stop + 4 + size + 4, len(held))
        kind, digest, length, fine, capture = f.get("warc-type"), None, None, None, None
        if kind in ("response", "revisit"):
            payload = body.partition(b"\r\n\r\n")[2]
            digest = f.get("warc-payload-digest", "").partition(":")[2]
            length = int(f.get("x-payload-length", len(payload)))
            if kind == "response":
                length = len(payload)
                found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                fine, digest = digest in ("", found), found
            body = payload
        elif kind == "metadata":
            value = body.decode().partition("capture:")[2].strip()
            capture = int(value) if value not in ("", "-") else None
        yield (
            f.get("warc-record-id"), kind, f.get("warc-concurrent-to"), f.get("warc-refers-to"),
            f.get("warc-target-uri"), capture, int(first) if (first := f.get("x-refers-to-capture")) else None, digest, length, fine, body,
        )


def read_archives(spark: SparkSession, path: str, bodies: bool = True) -> DataFrame:
    """Records of all archives below ``path``; ``bodies=False`` leaves payloads out."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("record_id", pa.string()), ("record_type", pa.string()), ("concurrent_to", pa.string()), ("refers_to_record", pa.string()), ("target_uri", pa.string()), ("capture_id", pa.int64()), ("refers_to_capture", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("digest_ok", pa.bool_()), ("body", pa.binary())]
        )
        for batch in batches:
            for content in batch.column(0):
                rows = []
                data = content.as_py()
                for row in parse_archive(data):
                    rows.append(row if bodies else (*row[:-1], None))
                    if len(rows) == 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return read_blobs(spark, path).select("content").mapInArrow(parse, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: main record joined with its request and metadata.

    One shuffle: every record is keyed by the main record it belongs to (a main
    record by its own id), and a group holds the few records of one capture.
    Records whose main record is missing give no row; a capture without request
    or metadata has null there.
    """
    part = F.struct("record_id", "target_uri", "capture_id", "refers_to_capture", "payload_digest", "payload_bytes", "digest_ok", "refers_to_record", "record_type", "body")
    main = F.col("record_type").isin("response", "revisit")
    keyed = records.select(
        F.when(main, F.col("record_id")).otherwise(F.col("concurrent_to")).alias("transaction_id"),
        F.when(main, F.lit("main")).otherwise(F.col("record_type")).alias("_part"),
        part.alias("_record"),
    ).where(F.col("transaction_id").isNotNull())
    one = lambda kind: F.min(F.when(F.col("_part") == kind, F.col("_record")))
    rows = keyed.groupBy("transaction_id").agg(
        one("main").alias("response"), one("request").alias("request"), one("metadata").alias("metadata")
    )
    return rows.where(F.col("response").isNotNull())


def digest(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` to archives, read them back, return one row per capture."""
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    write_archives(archive_records(with_first_capture(pages)), path)
    captures = assemble(read_archives(spark, path, bodies=False))
    return captures.select(
        F.col("metadata.capture_id").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        F.col("response.refers_to_capture").alias("refers_to"),
    )
