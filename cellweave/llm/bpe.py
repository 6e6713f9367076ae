"""Byte-level BPE with a minimal acyclic transducer of frequent words.

* ``count_words`` (module ``words``) counts all words of the corpus; the
  ``lexicon_words`` most frequent are encoded once and compiled into an
  automaton that shares prefixes and suffixes.  Every transition carries an
  output; the outputs along a word add up to its number, which indexes its ids.
* The automaton is a flat file image: broadcast (its size is bounded by the
  number of words), written to a temp file by each Python worker, memory-mapped
  and unlinked at once.  Words are looked up in it many at a time.
* Words it does not hold are merged exactly, lowest rank and leftmost pair
  first, many words at a time (long ones with a heap).

Texts are cut in pieces at spaces that are followed by something other than
white space: the vocabulary's splitter always begins a new token there, so a
piece's ids do not depend on its neighbours and can be remembered.  A piece is
split, merged and decoded once, together with all others that are new; texts
join what is remembered.  Texts that contain an added token's string are first cut at those, as the library does.

Defined cases: a null text is an empty one and has no ids; any Unicode text is
encoded, at any length; an empty table gives no rows; repeated rows are encoded
alike; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import re
import tempfile
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from cellweave.llm.common import cut, kept
from cellweave.llm.sstable import byte_alphabet
from cellweave.llm.words import TwoGenerations, count_words, text_bytes, top_words

#: Fixed value: the splitter of byte-level vocabularies of this family.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEXICON_WORDS = 60_000
#: Pieces that are learned, and strings that are joined, at once; bounds the arrays of places.
TOGETHER = 1 << 15
NONE = np.int32(1 << 30)
#: Texts with a space before other white space, or with NUL, are cut with more care.
ODD = re.compile(" \\s|\0")


def runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all runs, one run after the other."""
    end = np.cumsum(size)
    return np.repeat(start - (end - size), size) + np.arange(end[-1] if len(end) else 0)


def sliced(text: bytes, size: np.ndarray, drop: int = 0) -> list[bytes]:
    """Runs of ``text`` of these sizes, each without its last ``drop`` bytes."""
    end = np.cumsum(size)
    return [text[a:b] for a, b in zip((end - size).tolist(), (end - drop).tolist())]


class Strings:
    """Byte strings by number, joined many at a time."""

    def __init__(self, strings: list[bytes]) -> None:
        self.size = np.fromiter(map(len, strings), np.int64, len(strings))
        self.text, self.start = np.frombuffer(b"".join(strings), np.uint8), np.cumsum(self.size) - self.size

    def join(self, numbers: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The joined strings and the size of each."""
        size = self.size[numbers]
        parts = [slice(at, at + TOGETHER) for at in range(0, len(numbers), TOGETHER)]
        return b"".join([self.text[runs(self.start[numbers[p]], size[p])].tobytes() for p in parts]), size


class Vocabulary:
    """Merges, token bytes and added tokens of a tokenizers-library BPE file."""

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        split = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or split.get("type") != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
            raise ValueError("this encoder is for byte-level tokenizers without a normaliser")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must stand for themselves alone")
        model, alphabet = spec["model"], byte_alphabet()
        byte_of = {c: b for b, c in enumerate(alphabet)}
        vocab = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.added.values()]) + 1
        self.token = [b""] * self.size
        for t, i in vocab.items():
            self.token[i] = bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode()
        for t, i in self.added.items():
            self.token[i] = t.encode()
        self.byte_ids = np.array([vocab[c] for c in alphabet], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.rank = {(a, b): r for r, (a, b) in enumerate(zip(self.left.tolist(), self.right.tolist()))}
        key = self.left * self.size + self.right
        self.order = np.argsort(key).astype(np.int32)
        self.keys = key[self.order]
        self._slots()
        byte = np.arange(256)
        self.byte_ranks = self.ranks(self.byte_ids[byte].repeat(256), self.byte_ids[np.tile(byte, 256)]).astype(np.int32)
        self.kind = "<u2" if self.size <= 1 << 16 else "<u4"
        self.split = regex.compile(SPLIT)
        self.cut_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def _slots(self) -> None:
        """A hash table of merges: 2^20 slots, what collides stays for binary search."""
        self.mask = (1 << 20) - 1
        key = self.left * self.size + self.right
        at = self._hash(key)
        self.slot = np.full(1 << 20, -1, np.int32)
        self.slot[at[::-1]] = np.arange(len(key), dtype=np.int32)[::-1]
        self.slot_key = np.where(self.slot >= 0, key[self.slot], -1)
        self.shared = np.zeros(1 << 20, bool)
        many = np.bincount(at, minlength=1 << 20)
        self.shared[many > 1] = True

    def _hash(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.int64(1640531527)) >> np.int64(11)) & self.mask

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of symbol pairs, ``NONE`` where there is no merge."""
        key = (left.astype(np.int64) * self.size + right).ravel()
        at = self._hash(key)
        out = np.where(self.slot_key[at] == key, self.slot[at], NONE)
        if (rest := np.flatnonzero((out == NONE) & self.shared[at])).size:
            k = key[rest]
            p = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
            out[rest] = np.where(self.keys[p] == k, self.order[p], NONE)
        return np.where((left < 0) | (right < 0), NONE, out.reshape(left.shape))

    def merge_one(self, word: bytes) -> list[int]:
        """Exact merges of one word of any length, with a heap over a linked list."""
        sym = [int(self.byte_ids[b]) for b in word]
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := self.rank.get((sym[i], sym[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if sym[i] >= 0 else n
            if j >= n or sym[i] != a or sym[j] != b:
                continue
            sym[i], sym[j] = int(self.made[r]), -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < n:
                    x, y = sym[left], sym[after[left]]
                    if (q := self.rank.get((x, y))) is not None:
                        heapq.heappush(heap, (q, left, x, y))
        return [s for s in sym if s >= 0]

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of every word, by exact merges."""
        ids, size = self.merge_flat(words)
        return sliced(ids.astype(self.kind).tobytes(), size * np.dtype(self.kind).itemsize)

    def merge_flat(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and how many each word has."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        text, start = np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size
        order, ids, count = [np.flatnonzero(size == 0)], [np.zeros(0, np.int32)], []
        count.append(np.zeros(len(order[0]), np.int64))
        for low, high in ((1, 8), (9, 16), (17, 32), (33, 64)):
            where = np.flatnonzero((size >= low) & (size <= high))
            for at in range(0, len(where), 16384):
                block = where[at : at + 16384]
                found = self._merge_block(text, start[block], size[block])
                order.append(block)
                ids.append(found[0])
                count.append(found[1])
        for i in np.flatnonzero(size > 64).tolist():
            order.append(np.array([i]))
            ids.append(np.array(self.merge_one(words[i]), np.int32))
            count.append(np.array([len(ids[-1])]))
        where, many = np.concatenate(order), np.concatenate(count)
        begin, held = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        begin[where], held[where] = np.cumsum(many) - many, many
        return np.concatenate(ids)[runs(begin, held)], held

    def _merge_block(self, text: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``merge_flat`` of words of 64 bytes or fewer that begin at ``start`` in ``text``.

        A column is a word.  Symbols stay where they are and name their neighbours; a merge's
        key is its rank and place, so the least key of a column is its next merge.
        """
        n, width = len(size), int(size.max())
        place = np.arange(width + 1, dtype=np.int32)[:, None]
        inside = place < size
        byte = text[np.where(inside, start + place, 0)].astype(np.int32)
        sym = np.where(inside, self.byte_ids[byte], -1)
        key = np.full((width + 1, n), NONE)
        first = self.byte_ranks[byte[:-1] << 8 | byte[1:]]
        key[:-1] = np.where(inside[1:] & (first < NONE), first << 6 | place[:-1], NONE)
        after, before = np.empty((width + 1, n), np.int32), np.empty((width + 1, n), np.int32)
        after[:], before[:] = np.minimum(place + 1, width), np.where(place, place - 1, width)
        flat, column = sym.ravel(), np.arange(n)
        while True:
            best = key.min(0)
            live = np.flatnonzero(best < NONE)
            if not live.size:
                break
            if 4 * live.size < 3 * len(best):
                key, after, before = (np.take(x, live, 1) for x in (key, after, before))
                column, best = column[live], best[live]
                live = np.arange(len(best))
            else:
                best = best[live]
            m, c = key.shape[1], column[live]
            p, made = best & 63, self.made[best >> 6]
            here = p * m + live
            q = after.ravel()[here]
            there = q * m + live
            r, o = after.ravel()[there], before.ravel()[here]
            flat[p * n + c], flat[q * n + c] = made, -1
            after.ravel()[here], before.ravel()[r * m + live] = r, p
            rank = self.ranks(np.concatenate([made, flat[o * n + c]]), np.concatenate([flat[r * n + c], made]))
            rank = np.where(rank < NONE, rank << 6 | np.concatenate([p, o]), NONE)
            key.ravel()[there] = NONE
            key.ravel()[here], key.ravel()[o * m + live] = rank[: len(live)], rank[len(live) :]
        sym = sym.T
        left = sym >= 0
        return sym[left], left.sum(1)


def compile_lexicon(entries: dict[bytes, bytes], kind: str) -> bytes:
    """The minimal acyclic automaton of ``entries`` (word -> packed ids) as a file image.

    Words are added in order; a state whose subtree is complete is replaced by
    an equal one where there is one (equal finality and transitions), so
    suffixes are shared.  A state's count of words below it gives the outputs.
    """
    register: dict[tuple, int] = {}
    finals: list[bool] = []
    edges: list[list[tuple[int, int]]] = []
    counts: list[int] = []

    def settle(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(finals)
            finals.append(node[0])
            edges.append(list(node[1]))
            counts.append(node[0] + sum(counts[t] for _, t in node[1]))
        return register[key]

    path: list[list] = [[False, []]]
    last = b""
    words = sorted(entries)
    for word in words:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        while len(path) > same + 1:
            done = settle(path.pop())
            path[-1][1].append((last[len(path) - 1], done))
        for _ in word[same:]:
            path.append([False, []])
        path[-1][0] = True
        last = word
    while len(path) > 1:
        done = settle(path.pop())
        path[-1][1].append((last[len(path) - 1], done))
    root = settle(path[0])
    key, target, output = [], [], []
    for state, out in enumerate(edges):
        passed = int(finals[state])
        for label, to in out:  # in label order, as words came in order
            key.append(state << 8 | label)
            target.append(to)
            output.append(passed)
            passed += counts[to]
    ids = [entries[w] for w in words]
    ends = np.cumsum([0, *map(len, ids)]).astype("<i8")
    parts = [
        np.array([len(finals), len(key), len(words), root], "<i8"), np.array(key, "<i8"), np.array(target, "<i4"),
        np.array(output, "<i4"), np.array(finals, "u1"), ends,
    ]
    pad = lambda b: b + bytes(-len(b) % 8)
    return b"".join(pad(p.tobytes()) for p in parts) + b"".join(ids)


class Lexicon:
    """Looks words up in a memory-mapped automaton, many at a time."""

    def __init__(self, image: bytes) -> None:
        fd, name = tempfile.mkstemp()
        try:
            with os.fdopen(fd, "w+b") as f:
                f.write(image)
                f.flush()
                self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        finally:
            os.unlink(name)
        at = 0

        def read(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(self.map, kind, n, at)
            at += -(-got.nbytes // 8) * 8
            return got

        states, n, words, self.root = read("<i8", 4).tolist()
        self.key, self.target, self.output = read("<i8", n), read("<i4", n), read("<i4", n)
        self.final, self.ends, self.ids_at = read("u1", states), read("<i8", words + 1), at

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 for those that are not held."""
        out = np.full(len(words), -1, np.int64)
        if not words or not len(self.key):
            return out
        size = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(size) - size
        live, state, total, depth = np.arange(len(words)), np.full(len(words), self.root), np.zeros(len(words), np.int64), 0
        while live.size:
            ended = size[live] == depth
            if ended.any():
                e = live[ended]
                good = self.final[state[e]] == 1
                out[e[good]] = total[e[good]]
                live = live[~ended]
            key = (state[live].astype(np.int64) << 8) | text[start[live] + depth]
            p = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            hit = self.key[p] == key
            live, p = live[hit], p[hit]
            state[live] = self.target[p]
            total[live] += self.output[p]
            depth += 1
        return out

    def pool(self, kind: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words and where each word's begin, its end last."""
        return np.frombuffer(self.map, kind, self.ends[-1] // np.dtype(kind).itemsize, self.ids_at), self.ends // np.dtype(kind).itemsize


class Coder:
    """Encodes and decodes whole texts; ``decimal``: remembers ids as decimal numbers joined by commas."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None, memo: int = 300_000, decimal: bool = False) -> None:
        self.v, self.lexicon, self.memo = vocabulary, lexicon, TwoGenerations(memo)
        self.decimal = Strings([b"%d," % i for i in range(vocabulary.size)]) if decimal else None
        self.token = Strings(vocabulary.token)
        #: Whether every piece that was met decodes to itself.
        self.faithful = True

    @staticmethod
    def pieces(text: str) -> list[str]:
        """Cut before each space that something other than white space follows."""
        plain = " \n" not in text and text.replace("\n", "").isprintable()
        if "  " not in text and (plain or not ODD.search(text)) and text[-1:] != " " and text[:1] != " ":
            return text.replace(" ", "\0 ").split("\0") if text else []
        first, *rest = text.split(" ")
        out = [first] if first else []
        for part in rest:
            if part and not part[0].isspace() or not out:
                out.append(" " + part)
            else:
                out[-1] += " " + part
        return out

    def words(self, pieces: list[str]) -> tuple[list[str], np.ndarray]:
        """The words of all ``pieces`` and how many each has; each begins with a space and something other than white space."""
        words = self.v.split.findall("".join(pieces))
        at, ends = (np.cumsum(np.fromiter(map(len, x), np.int64, len(x))) for x in (words, pieces))
        return words, np.diff(np.searchsorted(at, ends) + 1, prepend=0)

    def words_to_ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where in them the ids of each word begin and how many they are."""
        numbers = self.lexicon.numbers(words) if self.lexicon else np.full(len(words), -1)
        unseen = np.flatnonzero(numbers < 0)
        merged, size = self.v.merge_flat([words[i] for i in unseen.tolist()])
        begin, held = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        begin[unseen], held[unseen] = np.cumsum(size) - size, size
        if len(unseen) == len(words):
            return merged, begin, held
        pool, at = self.lexicon.pool(self.v.kind), numbers >= 0
        begin[at], held[at] = pool[1][numbers[at]] + len(merged), np.diff(pool[1])[numbers[at]]
        return np.concatenate([merged, pool[0]]), begin, held

    def learn(self, new: list[str]) -> dict[str, bytes]:
        """The ids of ``new`` pieces as the memo holds them; a piece is split, merged and decoded here only."""
        out = {}
        for at in range(0, len(new), TOGETHER):
            out.update(self._learn(new[at : at + TOGETHER]))
        return out

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        added = self.v.added
        out = {p: b"%d" % added[p] if self.decimal else np.array([added[p]], self.v.kind).tobytes() for p in added.keys() & set(new)}
        self.faithful &= all(self.v.token[added[p]] == p.encode() for p in out)
        firsts = [p for p in new if (p[0] != " " or len(p) == 1 or p[1].isspace()) and p not in out]
        alone = {*out, *firsts}
        pieces = [p for p in new if p not in alone]
        words, many = self.words(pieces) if pieces else ([], np.zeros(0, np.int64))
        own = [self.v.split.findall(p) for p in firsts]
        words += [w for ws in own for w in ws]
        many = np.concatenate([many, np.fromiter(map(len, own), np.int64, len(own))])
        pieces += firsts
        if not pieces:
            return out
        number = dict(zip(distinct := dict.fromkeys(words), range(len(words))))
        bytes_of = [w.encode() for w in distinct]
        pool, begin, held = self.words_to_ids(bytes_of)
        which = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        first_word = np.cumsum(many) - many
        ids = pool[runs(begin[which], held[which])]
        n_ids = np.add.reduceat(held[which], first_word)
        first_id = np.cumsum(n_ids) - n_ids
        decoded, size = self.token.join(ids)
        n_bytes = np.add.reduceat(np.fromiter(map(len, bytes_of), np.int64, len(bytes_of))[which], first_word)
        self.faithful &= decoded == "".join(pieces).encode() and bool((np.add.reduceat(size, first_id) == n_bytes).all())
        if self.decimal:
            text, size = self.decimal.join(ids)
            packed = sliced(text, np.add.reduceat(size, first_id), 1)
        else:
            packed = sliced(ids.astype(self.v.kind).tobytes(), n_ids * np.dtype(self.v.kind).itemsize)
        out.update(zip(pieces, packed))
        return out

    def packed(self, texts: Sequence[str]) -> list[list[bytes]]:
        """What the memo holds of each text's pieces."""
        flat, ends = [], []
        for text in texts:
            if self.v.cut_added and any(t in text for t in self.v.added):
                for part in self.v.cut_added.split(text):
                    flat += [part] if part in self.v.added else self.pieces(part)
            else:
                flat += self.pieces(text)
            ends.append(len(flat))
        held = self.memo.values(flat, self.learn)
        return [held[a:b] for a, b in zip([0, *ends], ends)]

    def encode_many(self, texts: Sequence[str]) -> list[np.ndarray]:
        return [np.frombuffer(b"".join(held), self.v.kind) for held in self.packed(texts)]

    def round_trips(self, texts: Sequence[str]) -> Iterator[tuple[int, bytes, bytes]]:
        """Of each text the number of ids, the decimal ids joined by commas and the decoded text in UTF-8."""
        for text, held in zip(texts, self.packed(texts)):
            listed = b",".join(held)
            decoded = text if self.faithful else self.decode([int(i) for i in listed.split(b",") if i])
            yield listed.count(b",") + (listed != b""), listed, decoded.encode()

    def decode(self, ids: Sequence[int]) -> str:
        return b"".join(map(self.v.token.__getitem__, ids)).decode("utf-8", "replace")


def build_lexicon(docs: DataFrame, vocabulary: Vocabulary, words: int = LEXICON_WORDS, small: bool = False) -> bytes:
    """Count the words of all ``docs``; compile the ``words`` most frequent."""
    top = top_words(cut(count_words(docs), "words", small), words) if words else []
    known = {w.encode() for word, _ in top for w in vocabulary.split.findall(" " + word.decode("utf-8", "replace"))}
    ordered = sorted(known)
    return compile_lexicon(dict(zip(ordered, vocabulary.merge_many(ordered))), vocabulary.kind)


def coder_for(tokenizer: str, image: bytes, decimal: bool = False) -> Coder:
    """One coder per Python worker, kept between tasks of a job."""
    return kept(("bpe", hash(tokenizer), hash(image), decimal), lambda: Coder(Vocabulary(tokenizer), Lexicon(image), decimal=decimal))


def groups(batch: pa.RecordBatch, column: int, limit: int = 2 << 20) -> Iterator[tuple[int, list[str]]]:
    """Texts of a batch in runs of about ``limit`` bytes: (first row, texts)."""
    first, held, size = 0, [], 0
    for i, value in enumerate(batch.column(column)):
        text = value.as_py()
        held.append(text.decode("utf-8", "replace"))
        size += len(text)
        if size >= limit:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def round_trip(docs: DataFrame, tokenizer: str, lexicon_words: int = LEXICON_WORDS, small: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document; ``small``: of rows that ``cut`` writes, from batches that hold few texts."""
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        text = f.read()
    shared = spark.sparkContext.broadcast((text, build_lexicon(docs, Vocabulary(text), lexicon_words, small)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_for(*shared.value, decimal=True)
        for batch in batches:
            for first, texts in groups(batch, 1):
                counts, ids_sha, text_sha = [], [], []
                for count, listed, decoded in coder.round_trips(texts):
                    counts.append(count)
                    ids_sha.append(hashlib.sha256(listed).hexdigest())
                    text_sha.append(hashlib.sha256(decoded).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    out = text_bytes(docs, "doc_id").mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
    return cut(out, "tokens", True) if small else out


def encode(docs: DataFrame, tokenizer: str, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """doc_id and ids (array of int) of every document."""
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        text = f.read()
    shared = spark.sparkContext.broadcast((text, build_lexicon(docs, Vocabulary(text), lexicon_words)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_for(*shared.value)
        for batch in batches:
            for first, texts in groups(batch, 1):
                ids = [x.astype(np.int32) for x in coder.encode_many(texts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"]
                )

    return text_bytes(docs, "doc_id").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")
