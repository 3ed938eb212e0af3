"""Pieces of a text that the merges of a piece model never join, and what each of them encodes to."""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa

#: A line feed or tab; spaces with the word they stand before; spaces before a line's end.
SEGMENT = re.compile(r"[\n\t]| *[^ \n\t]+| +")
SPACE = "▁"
#: Entries of a worker's cache; it is emptied when full, so memory is bounded.
CACHE = 500_000


def segments(text: str) -> list[str]:
    """The model puts a space before a text and writes all spaces as U+2581, also those that a text
    itself spells so. No piece has a space behind another character, and none but single bytes has a
    line feed or tab (`check_model`), so no merge crosses the end of a segment, and ids of a text are
    the ids of its segments one after the other."""
    return SEGMENT.findall(" " + text.replace(SPACE, " ")) if text else []


def cut(texts: list[str]) -> tuple[pa.LargeStringArray, np.ndarray]:
    """What `segments` gives for all texts, one behind the other, and the number of each text's. The marks
    are found in the bytes of all texts at once, and no segment becomes a string of Python's."""
    spaced = pa.array([" " + text.replace(SPACE, " ") if text else "" for text in texts], pa.large_string())
    _, ends, data = spaced.buffers()
    bounds = np.frombuffer(ends, np.int64)[: len(texts) + 1]
    if not bounds[-1]:
        return pa.array([], pa.large_string()), np.zeros(len(texts), np.int64)
    letters = np.frombuffer(data, np.uint8)[: bounds[-1]]
    blank, mark = letters == ord(" "), (letters == ord("\n")) | (letters == ord("\t"))
    opens = mark.copy()
    opens[1:] |= np.where(blank[1:], ~blank[:-1], mark[:-1])
    opens[bounds[:-1][np.diff(bounds) > 0]] = True
    first = np.flatnonzero(opens)
    table = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(np.append(first, bounds[-1]).astype(np.int64)), data)
    return table, np.diff(np.searchsorted(first, bounds))


def check_model(model) -> None:
    """Fail for a model to which the rule of `segments` does not apply."""
    for i in range(model.get_piece_size()):
        if model.is_byte(i) or model.is_control(i) or model.is_unknown(i):
            continue
        piece = model.id_to_piece(i)
        if SPACE in piece.lstrip(SPACE) or "\n" in piece or "\t" in piece:
            raise ValueError(f"piece {piece!r} joins segments")
    if model.encode("a  b", out_type=str)[0] != SPACE + "a":
        raise ValueError("the model puts no space before a text")


def load(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    check_model(model)
    return model


def encode_segment(model, segment: str) -> list[int]:
    if segment == " ":
        return [model.piece_to_id(SPACE)]
    if segment[0] == " ":  # the space is the one the model adds
        return model.encode(segment[1:])
    return model.encode("\n" + segment)[2:]  # behind a line feed no space is added; drop both


class Cache(dict):
    """What segments encode to, computed at the first miss."""

    def __init__(self, model, make: Callable[[list[int]], object], known: dict | None = None):
        super().__init__()
        self.model, self.make, self.known = model, make, known or {}

    def __missing__(self, segment: str):
        value = self.known.get(segment)
        if value is None:
            value = self.make(encode_segment(self.model, segment))
        if len(self) >= CACHE:
            self.clear()
        if len(segment) <= 64:  # long ones hardly come again
            self[segment] = value
        return value


    def encoded(self, texts: list[str]) -> list[bytes]:
        """For texts, the values of their segments joined; values are codes of two bytes."""
        return self._joined(*cut(texts))

    def joined(self, texts: list[list[str]]) -> list[bytes]:
        """As `encoded`, for texts given by their segments."""
        return self._joined(pa.array(chain.from_iterable(texts), pa.large_string()), np.fromiter(map(len, texts), np.int64, len(texts)))

    def _joined(self, pieces: pa.Array, counts: np.ndarray) -> list[bytes]:
        """Segments are told apart by a table of these texts alone, so each is looked up once for all of them,
        and the unknown ones are encoded together, which takes the library half the time of a call for each."""
        if not len(pieces):
            return [b""] * len(counts)
        table = pieces.dictionary_encode()
        # By way of numpy, which takes a fifth of the time of to_pylist().
        kinds, at = table.dictionary.to_numpy(zero_copy_only=False).tolist(), table.indices.to_numpy()
        values = list(map(self.get, kinds))
        new = [i for i, v in enumerate(values) if v is None]
        words = [i for i in new if kinds[i][0] == " " and kinds[i] != " " and kinds[i] not in self.known]
        for low in range(0, len(words), 10_000):
            some = words[low : low + 10_000]
            for i, ids in zip(some, self.model.encode([kinds[i][1:] for i in some], num_threads=1), strict=True):
                values[i] = self.make(ids)
        if len(self) + len(new) > CACHE:
            self.clear()
        for i in new:
            if values[i] is None:
                values[i] = self[kinds[i]]
            elif len(kinds[i]) <= 64 and len(self) < CACHE:
                self[kinds[i]] = values[i]
        size = np.fromiter(map(len, values), np.int64, len(values)) // 2
        first = np.cumsum(size) - size
        n = size[at]
        ends = np.cumsum(n)
        codes = np.frombuffer(b"".join(values), np.uint16)[np.repeat(first[at] - ends + n, n) + np.arange(ends[-1])]
        bounds = np.append(0, ends)[np.append(0, np.cumsum(counts))]
        return [codes[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def packed(ids: list[int]) -> bytes:
    return array("H", ids).tobytes() if sys.byteorder == "little" else np.array(ids, dtype="<u2").tobytes()
