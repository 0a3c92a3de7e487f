"""SentencePiece models read from their files: normalisation with source offsets, pieces, decoding.

A model file holds pieces and a compiled character map: a double array of byte strings, each
with the text that replaces it. Normalising takes the longest entry at each place, or one
character where none fits, and notes for every byte made the source byte it came from. The
library then merges the normalised text with a copy of the model that normalises no more, and
the lengths of the pieces lead back over the notes to byte spans of the source.

Models are refused that this does not cover: without byte fallback, with user-defined symbols,
that don't escape spaces, that mark the ends of words instead of their starts, or with pieces
that reach over the start of a word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np

SPACE = "▁"
#: Kinds of pieces in the file.
NORMAL, USER_DEFINED, BYTE = 1, 4, 6

#: Starts of words in a normalised text; texts are merged in parts of about so many characters, so that the library's memory follows no long text.
WORD = re.compile(f"(?<!{SPACE}){SPACE}")
PART = 1 << 16


def _number(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _number(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _number(data, at)
        else:
            if kind == 2:
                size, at = _number(data, at)
            elif kind in (1, 5):
                size = 8 if kind == 1 else 4
            else:
                raise ValueError(f"field of kind {kind}")
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def field(number: int, value: int | bytes) -> bytes:
    """One field of a message, as ``fields`` reads it (numbers and byte strings only)."""

    def digits(n: int) -> bytes:
        out = bytearray()
        while n >= 0x80:
            out.append(n & 0x7F | 0x80)
            n >>= 7
        return bytes([*out, n])

    if isinstance(value, int):
        return digits(number << 3) + digits(value)
    return digits(number << 3 | 2) + digits(len(value)) + value


class CharacterMap:
    """The compiled map of a model: replacements of byte strings, found by their longest prefix."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.texts = blob[4 + size :] if blob else b""
        #: Bytes that some entry begins with.
        self.heads = [b for b in range(1, 256) if self.units and self.units[self._below(0) ^ b] & 0x800000FF == b]

    def _below(self, node: int) -> int:
        unit = self.units[node]
        return node ^ (unit >> 10 << ((unit & 0x200) >> 6))

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """(replacement, length) of the longest entry that ``data`` has at ``at``."""
        if not self.units:
            return None
        found, node = None, self._below(0)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units) or not data[i] or self.units[node] & 0x800000FF != data[i]:
                break
            has_value, node = self.units[node] >> 8 & 1, self._below(node)
            if has_value:
                found = (self.units[node] & 0x7FFFFFFF, i + 1 - at)
        if found is None:
            return None
        start = found[0]
        return self.texts[start : self.texts.index(b"\0", start)], found[1]


class PieceModel:
    """A model file: ``normalize``, ``encode`` with byte spans of the source, ``decode``."""

    def __init__(self, data: bytes):
        import sentencepiece

        pieces: list[tuple[bytes, int]] = []
        rules, parts = dict[int, int | bytes](), []
        for number, value in fields(data):
            if number == 1:
                own = dict(fields(value))
                pieces.append((own[1], own.get(3, NORMAL)))
            if number == 2:
                trained = dict(fields(value))
            if number == 3:
                rules = dict(fields(value))
            else:
                parts.append(field(number, value))
        if sum(kind == BYTE for _, kind in pieces) != 256 or not trained.get(35):
            raise ValueError("the model has no byte fallback")
        if any(kind == USER_DEFINED for _, kind in pieces) or trained.get(24) or not rules.get(5, 1):
            raise ValueError("user-defined symbols, marks at ends of words and plain spaces are not supported")
        self.prefix, self.squeeze = bool(rules.get(3, 1)), bool(rules.get(4, 1))
        self.map = CharacterMap(rules.get(2, b""))
        #: Whether a normalised text is a space and the text.
        self.plain = self.prefix and not self.squeeze and not self.map.units
        heads = {*self.map.heads, *([0x20] if self.squeeze else [])}
        self.touched = re.compile(b"[" + b"".join(re.escape(bytes([b])) for b in sorted(heads)) + b"]") if heads else None
        #: Of each piece, its bytes in a normalised text; control pieces have none.
        self.length = np.array([1 if kind == BYTE else len(text) if kind == NORMAL else 0 for text, kind in pieces], np.int64)
        #: The same pieces as they stand in a text.
        self.shown = [bytes([int(text[3:5], 16)]) if kind == BYTE else text.replace(SPACE.encode(), b" ") if kind == NORMAL else b"" for text, kind in pieces]
        plain = field(1, b"identity") + field(2, b"") + field(3, 0) + field(4, 0) + field(5, 0)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.merger = sentencepiece.SentencePieceProcessor(model_proto=b"".join(parts) + field(3, plain))
        self.end = self.library.eos_id()
        # no merge crosses the start of a word if no piece has a space after another character
        if any(SPACE in text.decode().lstrip(SPACE) for text, kind in pieces if kind == NORMAL):
            raise ValueError("pieces across words are not supported")

    def normalize(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """(normalised text, for each of its bytes and its end the source byte it came from).

        All bytes of a replacement, and of a character, come from the first byte replaced.
        """
        size = len(text)
        if not text:
            return b"", np.zeros(1, np.int64)
        marked = self.squeeze and text.endswith(SPACE.encode())  # goes as a space at the end does
        if not marked and (self.touched is None or not self.touched.search(text)):
            data = np.frombuffer(text, np.uint8)
            begins = (data & 0xC0) != 0x80
            origin = np.flatnonzero(begins)[np.cumsum(begins) - 1]
            made, origin = text.replace(b" ", SPACE.encode()), np.repeat(origin, np.where(data == 0x20, 3, 1))
            if self.prefix:
                made, origin = SPACE.encode() + made, np.concatenate(([0, 0, 0], origin))
            return made, np.append(origin, size)
        out, sources = bytearray(), list[int]()
        at, after_space = 0, self.squeeze
        if self.squeeze:  # leading spaces, of whatever entry
            while at < size:
                made, length = self._step(text, at)
                if made != b" ":
                    break
                at += length
            if at == size:
                return b"", np.full(1, 0, np.int64)
        if self.prefix:
            out += SPACE.encode()
            sources += [at] * 3
        while at < size:
            made, length = self._step(text, at)
            if after_space:
                made = made.lstrip(b" ")
            if made:
                shown = made.replace(b" ", SPACE.encode())
                out += shown
                sources += [at] * len(shown)
                after_space = self.squeeze and made.endswith(b" ")
            at += length
        if self.squeeze:
            while out.endswith(SPACE.encode()):
                at = sources[-1]
                del out[-3:], sources[-3:]
        return bytes(out), np.array([*sources, at], np.int64)

    def _step(self, text: bytes, at: int) -> tuple[bytes, int]:
        found = self.map.longest(text, at)
        if found:
            return found
        first = text[at]
        length = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        return text[at : at + length], length

    def _parts(self, text: str) -> list[str]:
        """``text`` cut at starts of words, in parts of ``PART`` characters and one word."""
        out, begin = [], 0
        while len(text) - begin > PART and (found := WORD.search(text, begin + PART)):
            out.append(text[begin : found.start()])
            begin = found.start()
        return [*out, text[begin:]]

    def merge(self, normalized: list[str]) -> list[np.ndarray]:
        """Ids of each normalised text, without an end."""
        parts = [self._parts(text) for text in normalized]
        found = iter(self.merger.encode(list(chain.from_iterable(parts)), num_threads=1, return_type="numpy"))
        return [np.concatenate([next(found) for _ in own]) for own in parts]

    def encode(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, first source byte, end in the source) of each text's pieces; the end id has an empty span at the end."""
        made = [self.normalize(text) for text in texts]
        out = []
        for text, (_, origin), ids in zip(texts, made, self.merge([m.decode("utf-8", "replace") for m, _ in made]), strict=True):
            edges = np.concatenate(([0], np.cumsum(self.length[ids])))
            if edges[-1] != len(origin) - 1:
                raise ValueError("the pieces are not the normalised text")
            borders, size = origin[edges], len(text)
            out.append((np.append(ids, np.int32(self.end)), np.append(borders[:-1], size), np.append(borders[1:], size)))
        return out

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


#: One for each model file and Python worker, kept between tasks.
_WORKERS: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    if path not in _WORKERS:
        with open(path, "rb") as f:
            _WORKERS[path] = PieceModel(f.read())
    return _WORKERS[path]


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))
