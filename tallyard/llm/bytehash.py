"""Hashes of the words of UTF-8 bytes, for whole batches of texts at once."""

from __future__ import annotations

import numpy as np

MIX = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

#: Bytes that end a word.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_POWER = np.ones(1, np.uint64)


def finish(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix in which every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _POWER
    if len(_POWER) < n:
        factors = np.full(max(n, 4096), 0xD6E8FEB86659FD93, np.uint64)
        factors[0] = 1
        _POWER = np.cumprod(factors, dtype=np.uint64)
    return _POWER


def token_hashes(data: np.ndarray, starts: np.ndarray, outside: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each token, A-Z as a-z. Tokens begin at ``starts``; bytes ``outside`` belong to none.

    Sums of ``byte value * B ** place`` wrap at 64 bits.
    """
    if not len(starts):
        return np.empty(0, np.uint64)
    place = np.arange(len(data), dtype=np.int64)
    place -= np.repeat(starts, np.diff(starts, append=len(data), prepend=0)[1:] + np.concatenate(([starts[0]], np.zeros(len(starts) - 1, np.int64))))
    np.maximum(place, 0, out=place)
    place[outside] = 0
    value = _BYTE[LOWER[data]]
    value *= _powers(int(place.max()) + 1)[place]
    value[outside] = 0
    lengths = np.add.reduceat(~outside, starts, dtype=np.int64)
    return finish(np.add.reduceat(value, starts) ^ lengths.astype(np.uint64) * MIX)


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the words between white space."""
    space = SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    starts = np.flatnonzero(begins)
    return starts, token_hashes(data, starts, space)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of the texts with a space after each, offset of each text and of the end)."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    return data, offsets


class HashIndex:
    """A growing map from 64-bit keys to consecutive numbers, looked up by whole arrays."""

    def __init__(self, slots: int = 1 << 22):
        self.mask = np.int64(slots - 1)
        self.limit = slots // 2
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(int(self.mask) + 1, np.uint64)
        self.numbers = np.full(int(self.mask) + 1, -1, np.int32)
        self.size = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key, -1 where it is unknown."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        slot = (keys & np.uint64(self.mask)).astype(np.int64)
        while len(todo):
            number = self.numbers[slot]
            hit = (self.keys[slot] == keys[todo]) & (number >= 0)
            out[todo[hit]] = number[hit]
            on = ~hit & (number >= 0)
            todo, slot = todo[on], (slot[on] + 1) & self.mask
        return out

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Numbers for distinct unknown keys, in their order."""
        numbers = np.arange(self.size, self.size + len(keys), dtype=np.int32)
        todo = np.arange(len(keys))
        slot = (keys & np.uint64(self.mask)).astype(np.int64)
        while len(todo):
            free = self.numbers[slot] < 0
            self.numbers[slot[free]] = numbers[todo[free]]  # of rivals for a slot, the last stays
            won = free.copy()
            won[free] = self.numbers[slot[free]] == numbers[todo[free]]
            self.keys[slot[won]] = keys[todo[won]]
            todo, slot = todo[~won], (slot[~won] + 1) & self.mask
        self.size += len(keys)
        return numbers
