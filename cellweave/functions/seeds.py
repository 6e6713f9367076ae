"""Seeds, stable ids and a small generator for choices that the driver makes (sites, candidates)."""

from __future__ import annotations

import math

# Fixed values.
FNV_PRIME, FNV_START = 0x01000193, 0x811C9DC5
WEYL, MIX_A, MIX_B = 0x9E3779B9, 0x21F0AAAD, 0x735A2D97
WORD = 0xFFFFFFFF


def signed32(n: int) -> int:
    n &= WORD
    return n - (1 << 32) if n >> 31 else n


def fold(text: str, start: int) -> int:
    """FNV over UTF-16 code units, as an unsigned word."""
    h, raw = start & WORD, text.encode("utf-16-le", "surrogatepass")
    for at in range(0, len(raw), 2):
        h = (h ^ int.from_bytes(raw[at : at + 2], "little")) * FNV_PRIME & WORD
    return h


def derive_seed(project: int, node_id: str) -> int:
    """A node's own seed, so that two nodes of equal settings differ."""
    h = fold(node_id, project)
    return signed32(h ^ h >> 16)


def stable_id(name: str, version: str) -> int:
    return signed32(fold(f"{name}|{version}", FNV_START))


class Rng:
    """xoshiro128** with a splitmix start.  Sequential: for the driver, never for partitions."""

    def __init__(self, seed: int) -> None:
        self.words = []
        for step in range(1, 5):
            z = (seed + step * WEYL) & WORD
            z = (z ^ z >> 16) * MIX_A & WORD
            z = (z ^ z >> 15) * MIX_B & WORD
            self.words.append(z ^ z >> 15)

    def bits(self) -> int:
        turn = lambda v, k: (v << k | v >> (32 - k)) & WORD
        a, b, c, d = self.words
        out = turn(b * 5 & WORD, 7) * 9 & WORD
        c, d = c ^ a, d ^ b
        self.words = [a ^ d, b ^ c, c ^ (b << 9 & WORD), turn(d, 11)]
        return out

    def next(self) -> float:
        return self.bits() / (1 << 32)

    def range(self, low: float, high: float) -> float:
        return low + self.next() * (high - low)

    def int(self, n: int) -> int:
        return math.floor(self.next() * n)

    def gaussian(self) -> float:
        u = self.next()
        while u == 0:
            u = self.next()
        return math.sqrt(-2 * math.log(u)) * math.cos(2 * math.pi * self.next())
