"""What tokenizers make of texts, by way of their words, which recur and are worked out once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np

#: Words, and characters of them, that are remembered before the cache starts afresh; words looked up at once; characters worked out at once.
WORDS, CHARACTERS, TURN, PART = 1 << 19, 1 << 23, 1 << 16, 1 << 16


class Records(NamedTuple):
    """Of some words, in their order: values laid end to end, their number for each word, further numbers (words, n), and texts."""

    values: np.ndarray
    counts: np.ndarray
    numbers: np.ndarray
    texts: list[str]


class WordCache:
    """``learn`` gives the records of words, a group at a time. Words that may not be joined with others come alone.

    ``joins`` tells of a word whether it may stand beside others in a joined text.
    """

    def __init__(self, learn: Callable[[list[str]], Records], joins: Callable[[str], bool], width: int = 0):
        self.learn, self.joins, self.width = learn, joins, width
        self._reset()

    def _reset(self) -> None:
        self.number: dict[str, int] = {}
        self.characters = self.used = 0
        self.values = np.empty(1 << 16, np.uint32)
        self.first, self.count = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)
        self.numbers = np.empty((1 << 14, self.width), np.int64)
        self.texts: list[str] = []

    def _add(self, words: list[str], own: Records) -> None:
        at, n = len(self.number), len(words)
        while len(self.first) < at + n:
            self.first, self.count, self.numbers = (np.concatenate((x, np.empty_like(x))) for x in (self.first, self.count, self.numbers))
        while len(self.values) < self.used + len(own.values):
            self.values = np.concatenate((self.values, np.empty_like(self.values)))
        self.values[self.used : self.used + len(own.values)] = own.values
        self.first[at : at + n] = self.used + np.cumsum(own.counts) - own.counts
        self.count[at : at + n] = own.counts
        self.numbers[at : at + n] = own.numbers
        self.texts += own.texts
        self.used += len(own.values)
        self.number.update(zip(words, range(at, at + n), strict=True))
        self.characters += sum(map(len, words))

    def _groups(self, words: list[str]) -> Iterator[list[str]]:
        group, size = list[str](), 0
        for word in words:
            if len(word) > PART or not self.joins(word):
                yield [word]
                continue
            group.append(word)
            size += len(word)
            if size > PART:
                yield group
                group, size = [], 0
        if group:
            yield group

    def _find(self, words: list[str]) -> np.ndarray:
        found = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new = list(dict.fromkeys(words[i] for i in missing.tolist()))
            if len(self.number) + len(new) > WORDS or self.characters > CHARACTERS:
                self._reset()
                new, missing = list(dict.fromkeys(words)), np.arange(len(words))
            for group in self._groups(new):
                self._add(group, self.learn(group))
            found[missing] = np.fromiter((self.number[words[i]] for i in missing.tolist()), np.int64, len(missing))
        return found

    def records(self, words: list[str]) -> Records:
        """Those of ``words``, however many."""
        values, counts, numbers, texts = [np.empty(0, np.uint32)], [np.empty(0, np.int64)], [np.empty((0, self.width), np.int64)], list[str]()
        for at in range(0, len(words), TURN):
            found = self._find(words[at : at + TURN])
            count = self.count[found]
            total = np.cumsum(count)
            values.append(self.values[np.repeat(self.first[found] - (total - count), count) + np.arange(total[-1])])
            counts.append(count)
            numbers.append(self.numbers[found])
            if self.texts:
                texts += map(self.texts.__getitem__, found.tolist())
        return Records(np.concatenate(values), np.concatenate(counts), np.concatenate(numbers), texts)


def borders(words: list[str], data: bytes) -> np.ndarray:
    """Byte offsets of the ends of ``words`` in ``data``, the words joined and encoded."""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    if len(words) and ends[-1] == len(data):
        return ends
    begins = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    return np.append(begins, len(data))[ends]
