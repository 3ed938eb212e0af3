"""Recompression of word sequences: rounds that name runs and pairs, with what each name depends on.

Sequences are laid end to end in one array, with a separator before each and after the last. A round names
runs of one symbol, then pairs of a left and a right symbol; which symbols are left and which right is
decided by a hash of the symbol and the round. Names are 64-bit hashes of what they stand for, so tasks
that never met give equal runs and pairs the same name in every round. A pair is made or not by looking at
its two members and at their neighbours alone, so equal stretches get the same symbols but for a margin at
their ends; every symbol carries the stretch of words that decided it.
"""

from __future__ import annotations

import hashlib
from array import array
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

U = np.uint64
#: Words known to a worker; forgotten between chunks when there are more, so memory is bounded.
WORDS = 1_000_000
#: Multipliers of the two fingerprints; odd, so their powers have inverses.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Words(dict):
    """Words to places in two arrays of fingerprints."""

    def __init__(self):
        super().__init__()
        self.marks = (array("Q"), array("Q"))

    def __missing__(self, word: bytes) -> int:
        digest = hashlib.blake2b(word, digest_size=16).digest()
        if len(word) > 64:  # long words are known by their digest
            if (at := self.get(b"\0long\0" + digest)) is not None:
                return at
            word = b"\0long\0" + digest
        at = len(self.marks[0])
        for i in (0, 1):
            self.marks[i].append(int.from_bytes(digest[8 * i : 8 * i + 8], "little"))
        self[word] = at
        return at

    def places(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def look_up(self, places: np.ndarray) -> list[np.ndarray]:
        return [np.frombuffer(m, np.uint64)[places] if len(places) else np.empty(0, np.uint64) for m in self.marks]

    def trim(self) -> None:
        if len(self) > WORDS:
            self.clear()
            self.marks = (array("Q"), array("Q"))


@lru_cache(4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base ** 2, ... modulo 2 ** 64; kept for the next call of about this size."""
    return _powers(base, 1 << max(16, (n - 1).bit_length()))


class Prints:
    """Two 64-bit fingerprints of any stretch of a sequence of words."""

    def __init__(self, marks: list[np.ndarray]):
        self.sums, self.back = [], []
        for mark, base in zip(marks, BASES, strict=True):
            n = len(mark)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(mark * powers(base, n)[:n], out=sums[1:])
            self.sums.append(sums)
            self.back.append(powers(pow(base, -1, 2**64), n + 1))

    def of(self, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        sums = self.sums[which]
        return mix((sums[end] - sums[start]) * self.back[which][start] + (end - start).astype(np.uint64))


@dataclass
class Level:
    """Symbols of a round: name, first word, and the words [low, high) that decided the symbol."""

    name: np.ndarray
    at: np.ndarray
    low: np.ndarray
    high: np.ndarray
    separator: np.ndarray

    def __len__(self) -> int:
        return len(self.name)


def first_level(marks: np.ndarray, separators: np.ndarray) -> Level:
    at = np.arange(len(marks))
    separator = np.zeros(len(marks), bool)
    separator[separators] = True
    name = marks.copy()
    name[separators] = mix(separators.astype(np.uint64))  # each one of its own, and never in a pair
    return Level(name, at, at, at + 1, separator)


def next_level(x: Level, number: int) -> Level:
    """The symbols after one round more."""
    salt = mix(np.array([number + 1], np.uint64))[0]
    # Runs. The neighbours tell that a run ends.
    n = len(x)
    opens = np.ones(n, bool)
    opens[1:] = (x.name[1:] != x.name[:-1]) | x.separator[1:] | x.separator[:-1]
    first = np.flatnonzero(opens)
    last = np.append(first[1:], n) - 1
    length = last - first + 1
    base, separator = x.name[first], x.separator[first]
    name = np.where(length > 1, mix(base ^ mix(length.astype(np.uint64) ^ salt)), base)
    low, high = x.low[np.maximum(first - 1, 0)], x.high[np.minimum(last + 1, n - 1)]
    low, high = np.where(separator, x.low[first], low), np.where(separator, x.high[last], high)
    # Pairs. The side of a run is that of its symbol, so runs next to each other are told apart as above.
    right = (mix(base ^ salt) & U(1)).astype(bool)
    joins = np.zeros(len(first), bool)
    joins[:-1] = ~right[:-1] & right[1:] & ~separator[:-1] & ~separator[1:]
    pair = np.flatnonzero(joins)
    keep = np.ones(len(first), bool)
    keep[pair + 1] = False
    name[pair] = mix(name[pair] * U(BASES[0]) + mix(name[pair + 1] ^ salt))
    high[pair] = high[pair + 1]
    return Level(name[keep], x.at[first][keep], low[keep], high[keep], separator[keep])
