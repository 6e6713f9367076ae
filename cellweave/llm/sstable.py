"""Token ids in sorted-string-table shards.

A shard file holds documents in ascending key order::

    blocks   entries (varint shared, varint unshared, varint value bytes,
             key suffix, value), prefix-compressed against the key before, the
             first entry of a block in full
    index    per block: first key (13 bytes), offset u64, bytes u32, entries u32
    bloom    bit array, 7 probes by double hashing of XXH64 of the id part
    footer   84 bytes: offsets, counts, id width, CRC-32 of index and bloom, magic

A key is a null flag, the document id with its sign bit flipped (big-endian, so
byte order is id order) and the rank among documents of the same id.  A value
is the document's ids as little-endian unsigned integers, 2 bytes wide where
the vocabulary allows it, else 4.

Writing: documents are dealt by range of (id, hash of text), sorted, encoded and
packed in one pass; each shard is one row that Spark's committer writes as one
file.  Reading: any file system that Spark reads.  ``Shard`` looks up single
documents by Bloom filter and binary search in the index.

Defined cases: a null text is an empty one (its ids are the end id alone); null
ids sort first; documents of one id are all kept, ordered by text hash; an
empty table gives no shards and no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import sys
import zlib
from array import array
from collections.abc import Iterator
from json import loads

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.llm.common import cut, kept, read_blobs, scratch, write_blobs
from cellweave.llm.words import TwoGenerations, text_bytes

MAGIC = b"CWSST01\n"
FOOTER = struct.Struct("<QQQQQQQIB15s8s")
INDEX = struct.Struct("<13sQII")
BLOCK_BYTES = 64 << 10
SHARD_BYTES = 24 << 20
BLOOM_BITS, BLOOM_PROBES = 10, 7

#: The splitters and normalisers for which texts may be cut at white space, and plain words be coded by the model alone.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_SPLITTERS = [
    {"type": "Split", "pattern": {"Regex": WORD_SPLIT}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
WORD_NORMALISERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
#: Plain words are letters that need no normalisation beyond lower case, then a run of such marks or none: the splitter cuts between them,
#: and no added token is made of letters and such marks alone.
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿŒœ]+")
MARKS = b"!#$%&*.,;:?"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(moved)) for b in range(256)]


class WordCoder:
    """A tokenizers-library encoder with a memo of words.

    Texts are cut at ASCII white space, which the tokenizer drops and across
    which neither its normaliser nor its splitter looks.  A word is encoded once
    and remembered: plain words by the library's model on their letters, all
    others by the library's whole encoder.
    """

    def __init__(self, json: str, memo: int = 400_000) -> None:
        from tokenizers import Tokenizer

        spec = loads(json)
        if (spec["pre_tokenizer"] or {}).get("pretokenizers") != WORD_SPLITTERS or (spec["normalizer"] or {}).get("normalizers") != WORD_NORMALISERS:
            raise ValueError("this encoder is for tokenizers that lower-case and drop white space")
        if any(re.fullmatch(rf"{LETTERS.pattern}|[\w{MARKS.decode()}]+", t["content"]) for t in spec["added_tokens"]):
            raise ValueError("an added token may be part of a plain word")
        self.tokenizer = Tokenizer.from_str(json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.width = 2 if self.tokenizer.get_vocab_size(True) <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.code = "H" if self.width == 2 else "I"
        self.memo, self.pieces = TwoGenerations(memo), TwoGenerations(memo)
        self.alphabet = byte_alphabet()

    def pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def piece(self, letters: str) -> bytes:
        if (held := self.pieces.young.get(letters)) is not None:
            return held
        if (held := self.pieces.old.get(letters)) is None:
            if len(self.pieces.young) > self.pieces.limit:
                self.pieces.missing([])
            text = letters if letters.isascii() else "".join(self.alphabet[b] for b in letters.encode())
            held = self.pack([t.id for t in self.model.tokenize(text)])
        self.pieces.young[letters] = held
        return held

    def plain(self, word: bytes) -> bytes | None:
        """Packed ids of a plain word, None for others."""
        bare = word.rstrip(MARKS)
        if bare.isalpha():  # ASCII letters
            ids = self.piece(bare.lower().decode())
        elif not bare.isascii() and LETTERS.fullmatch(shown := bare.decode()):
            ids = self.piece(shown.lower())
        else:
            return None
        return ids if len(bare) == len(word) else ids + self.piece(word[len(bare) :].decode())

    def encode(self, text: bytes) -> bytes:
        """Packed ids of a whole text."""
        words = text.split()
        packed = list(map(self.memo.young.get, words))
        if lacking := [i for i, ids in enumerate(packed) if ids is None]:
            new = self.memo.missing([words[i] for i in lacking])
            young, hard = self.memo.young, []
            for word in new:
                if (ids := self.plain(word)) is None:
                    hard.append(word)
                else:
                    young[word] = ids
            for at in range(0, len(hard), 512):
                part = hard[at : at + 512]
                for word, got in zip(part, self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)):
                    young[word] = self.pack(got.ids)
            for i in lacking:
                packed[i] = young[words[i]]
        return b"".join(packed)


if sys.byteorder != "little":
    raise ImportError("shards are packed on little-endian machines")


def coder_for(json: str) -> WordCoder:
    """One coder per Python worker and tokenizer, kept between tasks."""
    return kept(("words", hash(json)), lambda: WordCoder(json))


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def id_key(doc_id: int | None) -> bytes:
    return b"\x00" + bytes(8) if doc_id is None else b"\x01" + ((doc_id + (1 << 63)) & (1 << 64) - 1).to_bytes(8, "big")


def key_id(key: bytes) -> int | None:
    return int.from_bytes(key[1:9], "big") - (1 << 63) if key[0] else None


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh64_intdigest(key)
    a, b = h & 0xFFFFFFFF, h >> 32 | 1
    return [(a + i * b) % bits for i in range(BLOOM_PROBES)]


class ShardWriter:
    """Collects entries in key order and renders one shard."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.clear()

    def clear(self) -> None:
        self.blocks, self.index, self.block = [], [], bytearray()
        self.at = self.docs = self.ids = self.entries = 0
        self.last, self.first, self.keys = b"", b"", []

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.entries:
            while key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.entries += 1
        self.docs += 1
        self.ids += len(value) // self.width
        self.last = key
        self.keys.append(key[:9])
        if len(self.block) >= BLOCK_BYTES:
            self.end_block()

    def end_block(self) -> None:
        if self.entries:
            self.index.append(INDEX.pack(self.first, self.at, len(self.block), self.entries))
            self.blocks.append(bytes(self.block))
            self.at += len(self.block)
            self.block, self.entries = bytearray(), 0

    @property
    def size(self) -> int:
        return self.at + len(self.block)

    def image(self) -> bytes:
        self.end_block()
        bits = max(64, BLOOM_BITS * len(self.keys))
        bloom = bytearray(-(-bits // 8))
        for key in self.keys:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        index = b"".join(self.index)
        footer = FOOTER.pack(
            self.at, len(index), self.at + len(index), bits, len(self.index), self.docs, self.ids,
            zlib.crc32(index + bloom), self.width, b"", MAGIC,
        )
        out = b"".join([*self.blocks, index, bytes(bloom), footer])
        self.clear()
        return out


class Shard:
    """Reads one shard from bytes or a memory map."""

    def __init__(self, data: bytes) -> None:
        self.data = memoryview(data)
        (self.index_at, index_bytes, self.bloom_at, self.bits, self.n_blocks, self.docs, self.ids, crc, self.width, _, magic) = FOOTER.unpack(self.data[-FOOTER.size :])
        if magic != MAGIC or zlib.crc32(self.data[self.index_at : -FOOTER.size]) != crc:
            raise ValueError("not a shard, or damaged")
        self.kind = f"<u{self.width}"

    def block(self, i: int) -> tuple[bytes, int, int, int]:
        return INDEX.unpack_from(self.data, self.index_at + i * INDEX.size)

    def entries(self, i: int) -> Iterator[tuple[bytes, memoryview]]:
        _, at, size, n = self.block(i)
        data, key = self.data, b""
        for _ in range(n):
            nums = []
            for _ in range(3):
                v = shift = 0
                while True:
                    b = data[at]
                    at += 1
                    v |= (b & 0x7F) << shift
                    if b < 0x80:
                        break
                    shift += 7
                nums.append(v)
            shared, rest, size_ = nums
            key = key[:shared] + bytes(data[at : at + rest])
            at += rest
            yield key, data[at : at + size_]
            at += size_

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(self.n_blocks):
            for key, value in self.entries(i):
                yield key_id(key), np.frombuffer(value, self.kind)

    def maybe(self, key: bytes) -> bool:
        return all(self.data[self.bloom_at + (p >> 3)] >> (p & 7) & 1 for p in _probes(key, self.bits))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of every document of that id, found by binary search."""
        key = id_key(doc_id)
        if not self.docs or not self.maybe(key):
            return []
        low, high = 0, self.n_blocks - 1  # the last block whose first key is below ``key``
        while low < high:
            mid = (low + high + 1) // 2
            if self.block(mid)[0] < key:
                low = mid
            else:
                high = mid - 1
        out = []
        for i in range(low, self.n_blocks):
            for k, value in self.entries(i):
                if k[:9] == key:
                    out.append(np.frombuffer(value, self.kind))
                elif k[:9] > key:
                    return out
        return out


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int, shard_bytes: int = SHARD_BYTES) -> None:
    """Encode ``docs`` (doc_id, text) and write shards in ascending doc_id order.

    ``tokenizer`` is the path of a tokenizers-library file on the driver; its
    text (a few MB) is broadcast.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_for(shared.value)
        end, writer = coder.pack([end_id]), ShardWriter(coder.width)
        before, rank = object(), 0
        row = lambda: pa.RecordBatch.from_arrays([pa.array([writer.image()], pa.binary())], names=["image"])
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                rank = rank + 1 if doc_id == before else 0
                before = doc_id
                writer.add(id_key(doc_id) + rank.to_bytes(4, "big"), coder.encode(text.as_py()) + end)
                if writer.size >= shard_bytes:
                    yield row()
        if writer.docs:
            yield row()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = text_bytes(docs, F.col("doc_id").cast("long").alias("doc_id")).withColumn("_tie", F.xxhash64("_text"))
    ordered = ordered.repartitionByRange(parts, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
    write_blobs(ordered.select("doc_id", "_text").mapInArrow(pack, "image binary"), "image", path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """shard, first_key (of the shard, at place 0), doc_id, place (rank in the shard), before (ids before it in the shard), n_tokens, ids (packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard, seen, rows = Shard(content.as_py()), 0, []
                first = shard.block(0)[0]
                for place, (doc_id, ids) in enumerate(shard):
                    rows.append((name, None if place else first, doc_id, place, seen, len(ids), ids.astype("<u4").tobytes()))
                    seen += len(ids)
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=schema)

    names = ("shard", "first_key", "doc_id", "place", "before", "n_tokens", "ids")
    schema = pa.schema([("shard", pa.string()), ("first_key", pa.binary()), ("doc_id", pa.int64()), ("place", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    return read_blobs(spark, path).select("path", "content").mapInArrow(
        run, "shard string, first_key binary, doc_id long, place long, before long, n_tokens long, ids binary"
    )


def shard_starts(rows: DataFrame) -> DataFrame:
    """shard, shard_start: ids in the shards before it (one row a file), from ``read_documents``."""
    heads = rows.groupBy("shard").agg(F.min("first_key").alias("first_key"), F.max(F.col("before") + F.col("n_tokens")).alias("ids"))
    ordered = Window.orderBy("first_key", "shard").rowsBetween(Window.unboundedPreceding, -1)
    return heads.select("shard", F.coalesce(F.sum("ids").over(ordered), F.lit(0)).alias("shard_start"))


def digest(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, **how) -> DataFrame:
    """Write, read back (once), and return doc_id, start, n_tokens, ids_crc32 per document."""
    spark = docs.sparkSession
    path = path or scratch(spark, "sstable")
    write_shards(docs, path, tokenizer, end_id, **how)
    rows = cut(read_documents(spark, path).select("shard", "first_key", "doc_id", "before", "n_tokens", F.crc32("ids").alias("ids_crc32")), "shardrows")
    return rows.join(shard_starts(rows), "shard").select(
        "doc_id", (F.col("shard_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )
