"""Licence scans: exact phrases, and short notices within a bounded number of edits.

Texts become lower-case words joined by single spaces. Exact phrases are counted at
every place. For a notice with at most ``e`` edits, the notice is split into ``e + 1``
seeds; by the pigeonhole principle an occurrence holds at least one of them unchanged,
so exact search for seeds finds every candidate. The window around a candidate is then
verified with the regex library's bounded-error matching, which gives span and edits.

Defined results: null, empty and wordless texts have 0 words, null places, empty labels
and score 0; repeated rows are scanned each; columns other than doc_id and text are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyard.llm.common import slices, text_of

# fixed values
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
NOTICES = (
    ("licensed under the apache license version 2 0", "apache"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this work is licensed under the gnu general public license version", "gpl"),
    ("under the terms of the gnu lesser general public license", "lgpl"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under a creative commons attribution", "cc-by"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved", "reserved"),
)
#: Edits allowed: one for so many characters of the notice; seeds are about as long.
CHARS_PER_EDIT = 10
#: Words that tell a notice from those of other licences, and what may stand there instead.
TELLING = {
    "mit": ("bsd", "isc", "gpl", "mpl", "epl", "x11", "zlib", "cc0", "bsl"), "nc": ("sa", "nd"), "sa": ("nc", "nd"),
    "mozilla": ("eclipse", "netscape"), "lesser": ("affero",),
}

_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words_of(text: bytes) -> bytes:
    """Lower-cased words of UTF-8 bytes, joined by single spaces."""
    return b" ".join(text.translate(_WORD_BYTES).split())


def seeds(notice: str) -> list[tuple[int, bytes]]:
    """(offset, seed): the notice in one more part than edits are allowed."""
    edits = len(notice) // CHARS_PER_EDIT
    cuts = [i * len(notice) // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b].encode()) for a, b in zip(cuts, cuts[1:], strict=False)]


@cache
def _patterns(notices: tuple[tuple[str, str], ...] = NOTICES):
    import regex

    out = []
    for notice, label in notices:
        edits = len(notice) // CHARS_PER_EDIT
        at: dict[str, int] = {}
        for i, x in enumerate(notice):
            at[x] = at.get(x, 0) | 1 << i
        out.append((notice, label, edits, seeds(notice), at, regex.compile(rf"(?b)(?:{regex.escape(notice)}){{e<={edits}}}")))
    return out


def _holds(window: str, n: int, at: dict[str, int], edits: int) -> bool:
    """Whether some part of ``window`` is within ``edits`` of the n characters at places ``at``.

    A column of the table of distances is two bit vectors of steps (Myers); far cheaper than a failing search.
    """
    full, last = (1 << n) - 1, 1 << (n - 1)
    up, down, distance = full, 0, n
    for x in window:
        eq = at.get(x, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        more = down | (full & ~(diagonal | up))
        less = up & diagonal
        if more & last:
            distance += 1
        elif less & last:
            distance -= 1
            if distance <= edits:
                return True
        more, less = more << 1, less << 1
        up = (less | ~(diagonal | more)) & full
        down = more & diagonal & full
    return False


@cache
def _others(notice: str, edits: int):
    """Patterns of which none fits a span of ``notice`` with so many edits.

    Either another licence's word makes it closer, or all letters of the telling word went into the edits.
    """
    import regex

    out = []
    for word in set(notice.split()) & TELLING.keys():
        before, after = (regex.escape(x.strip()) for x in f" {notice} ".split(f" {word} "))
        around = lambda x, e: regex.compile(rf"(?:{before} {x} {after}){{e<={e}}}")  # noqa: B023, E731
        out += [around(x, edits - 1) for x in TELLING[word]]
        if edits >= len(word):
            out.append(around(r"\S+", edits - len(word)))
    return out


class _Places:
    """Number of the word at a byte, counted once for a text when it is first asked for."""

    def __init__(self, words: bytes):
        self.words, self.spaces = words, None

    def word(self, at: int) -> int:
        if self.spaces is None:
            self.spaces = np.flatnonzero(np.frombuffer(self.words, np.uint8) == 0x20)
        return int(np.searchsorted(self.spaces, at))


def fuzzy(words: bytes, notices: tuple[tuple[str, str], ...] = NOTICES) -> list[tuple[str, int, int, int, int]]:
    """(label, first word, last word, edits, length of the notice) of each notice found, in order."""
    found, count = set(), _Places(words)
    for notice, label, edits, parts, places, pattern in _patterns(notices):
        windows = []
        for offset, seed in parts:
            at = words.find(seed)
            while at >= 0:
                # offsets count bytes; an edit may have put in a character of four
                windows.append((max(0, at - offset - 4 * edits), at - offset + len(notice) + edits))
                at = words.find(seed, at + 1)
        end = -1
        for lo, hi in sorted(set(windows)):
            if hi <= end:
                continue  # within a span that is found already
            lo = max(lo, end, 0)
            hi += 4 * edits
            while lo > end and 0x80 <= words[lo] < 0xC0:  # whole characters only
                lo -= 1
            while hi < len(words) and 0x80 <= words[hi] < 0xC0:
                hi += 1
            window = words[lo:hi].decode("utf-8", "replace")
            if not _holds(window, len(notice), places, edits):
                continue
            if m := pattern.search(window):
                start = lo + len(window[: m.start()].encode())
                stop = lo + len(window[: m.end()].encode())
                while start < stop and words[start : start + 1] == b" ":
                    start += 1
                while stop > start and words[stop - 1 : stop] == b" ":
                    stop -= 1
                first = count.word(start)
                off = sum(m.fuzzy_counts)
                if not (off and any(x.fullmatch(m[0].strip()) for x in _others(notice, off))):
                    found.add((label, first, count.word(stop), off, len(notice)))
                end = stop
    return sorted(found, key=lambda x: (x[1], x[2], x[0]))


def scan(text: bytes, notices: tuple[tuple[str, str], ...] = NOTICES) -> tuple:
    words = words_of(text)
    if not words:
        return 0, 0, None, None, "", "", 0.0, ""
    framed = b" " + words + b" "
    places: list[int] = []
    exact, count = set(), _Places(words)
    for phrase, label in PHRASES:
        needle = f" {phrase} ".encode()
        at = framed.find(needle)
        while at >= 0:
            places.append(count.word(at))
            exact.add(label)
            at = framed.find(needle, at + 1)
    near = fuzzy(words, notices)
    score = max([1.0 if exact else 0.0, *(1 - edits / n for *_, edits, n in near)])
    return (
        words.count(b" ") + 1, len(places), min(places, default=None), max(places, default=None),
        ",".join(sorted(exact)), ",".join(sorted(exact | {x[0] for x in near})), score,
        ",".join(f"{label}:{a}:{b}:{edits}" for label, a, b, edits, _ in near),
    )


SCANNED = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, notices string"
)


def scan_licenses(docs: DataFrame, notices: tuple[tuple[str, str], ...] = NOTICES) -> DataFrame:
    """Counts, places, labels and near notices (label:first word:last word:edits) of each document.

    ``notices`` are pairs of lower-case words joined by single spaces, and a label.
    """
    types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.string()]
    names = [x.split()[0] for x in SCANNED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [scan(bytes(x.as_buffer() or b""), notices) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, SCANNED)
