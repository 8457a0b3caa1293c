"""Texts cut into the units that a tokenizer encodes by themselves, over whole Arrow buffers.

A *run* is a maximal stretch of bytes other than ``[\\x20\\x09-\\x0D]``.  Runs of ASCII and Latin-1
letters, ASCII digits and other ASCII characters are cut by class with vector operations; a
run with any other character, or with one that a tokenizer treats specially, is *odd*:
it is one unit, which the caller cuts by the tokenizer's own pattern.  Equal units of a
chunk are found by Arrow, so Python sees each distinct one once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .shingles import texts_in

#: Bytes of text that are worked on at once.
CHUNK = 1 << 22
BLANK, LETTER, DIGIT, OTHER, ODD = range(5)

_CLASS = np.full(256, ODD, np.uint8)
_CLASS[:0x80] = OTHER
for _a, _b, _c in ((0x09, 0x0D, BLANK), (0x20, 0x20, BLANK), (0x30, 0x39, DIGIT), (0x41, 0x5A, LETTER), (0x61, 0x7A, LETTER), (0x80, 0xBF, LETTER), (0xC3, 0xC3, LETTER)):
    _CLASS[_a : _b + 1] = _c
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def classes(data: np.ndarray, odd: bytes) -> np.ndarray:
    """A class for each byte; bytes of ``odd`` and letters beyond Latin-1 are odd."""
    table = _CLASS.copy()
    table[list(odd)] = ODD
    found = table[data]
    high = np.nonzero(data >= 0x80)[0]
    if len(high):
        value, lead = data[high], data[np.maximum(high - 1, 0)]
        inner = (value < 0xC0) & (lead != 0xC3)  # the rest of another character
        sign = (value < 0xC0) & (lead == 0xC3) & ((value == 0x97) | (value == 0xB7))  # a multiplication or division sign
        found[high[inner | sign]] = ODD
    return found


def lower(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters in lower case."""
    out = _LOWER[data]
    at = np.nonzero(data == 0xC3)[0] + 1
    at = at[(data[at] >= 0x80) & (data[at] <= 0x9E) & (data[at] != 0x97)]
    out[at] += 32
    return out


class Cut:
    """The distinct units of some texts: ``distinct`` (bytes), ``odd`` for each; ``of`` for each unit, and ``bounds`` of each text's units."""

    def __init__(self, data: np.ndarray, edges: np.ndarray, odd: bytes, glue: bool, single_digits: bool, fold: bool):
        n = len(data)
        kind = classes(data, odd)
        begins = np.zeros(n + 1, bool)
        begins[1:n] = kind[1:] != kind[:-1]
        begins[edges] = True
        if single_digits:
            begins[:n] |= kind == DIGIT
        full = np.zeros(n + 2, bool)
        full[1 : n + 1] = kind != BLANK
        edge = np.zeros(n + 1, bool)
        edge[edges] = True
        starts = np.nonzero(full[1:] & (~full[:-1] | edge))[0]  # of runs
        ends = np.nonzero(full[:-1] & (~full[1:] | edge))[0]
        if glue:
            self._glue(data, edge, full[1:-1], begins)
        odd_at = np.nonzero(kind == ODD)[0]
        marked = np.zeros(n + 1, bool)
        if len(odd_at):
            runs = np.unique(np.searchsorted(starts, odd_at, side="right") - 1)
            inside = np.zeros(n + 2, np.int8)
            np.add.at(inside, starts[runs] + 1, 1)
            np.add.at(inside, ends[runs], -1)
            begins &= np.cumsum(inside, dtype=np.int8)[: n + 1] == 0
            own = starts[runs]
            marked[np.where(begins[own], own, own - 1)] = True
        at = np.nonzero(begins[:n] if glue else begins[:n] & full[1:-1])[0]
        self.bounds = np.searchsorted(at, edges)
        if not len(at):
            self.distinct, self.odd, self.of = [], np.empty(0, bool), np.empty(0, np.int64)
            return
        text = lower(data) if fold else data
        if fold and len(odd_at):  # an odd unit stays as it is
            back = np.nonzero(np.cumsum(inside, dtype=np.int8)[:n] != 0)[0]
            text[back] = data[back]
            text[starts[runs]] = data[starts[runs]]
        if glue:
            stops = np.append(at, n)
        else:  # without the blanks
            text = text[full[1:-1]]
            kept = np.cumsum(full[1:-1], dtype=np.int32)
            stops = np.append(kept[at] - 1, len(text))
        units = pa.BinaryArray.from_buffers(
            pa.binary(), len(at), [None, pa.py_buffer(stops.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(text))]
        ).dictionary_encode()
        self.of = units.indices.to_numpy()
        self.distinct = units.dictionary.to_pylist()
        self.odd = np.zeros(len(self.distinct), bool)
        self.odd[self.of[marked[at]]] = True

    @staticmethod
    def _glue(data: np.ndarray, edge: np.ndarray, full: np.ndarray, begins: np.ndarray) -> None:
        """Blanks as units: the last of a run of blanks begins a unit, together with the run behind it if it is a space."""
        n = len(data)
        last = np.nonzero(~full & np.append(full[1:], False) & ~edge[1 : n + 1])[0]
        begins[last] = True
        begins[last[data[last] == 0x20] + 1] = False


def cuts(column, odd: bytes, glue: bool = False, single_digits: bool = False, fold: bool = False) -> Iterator[tuple[int, Cut, np.ndarray, np.ndarray]]:
    """(first row, cut, bytes, edges) for chunks of a text column; null texts are empty."""
    for row, data, edges in texts_in(column, CHUNK):
        yield row, Cut(data, edges, odd, glue, single_digits, fold), data, edges


def spread(values: np.ndarray, sizes: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The values of units ``of``, end to end, where unit k has the next ``sizes[k]`` of ``values``."""
    first = np.cumsum(sizes) - sizes
    size = sizes[of]
    ends = np.cumsum(size)
    return values[np.repeat(first[of] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
