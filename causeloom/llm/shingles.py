"""Word shingles as 64-bit numbers, computed over whole Arrow buffers.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]`` with A-Z in lower case.
A text's shingles are its runs of ``SIZE`` consecutive words; a text with fewer
words, but not none, has its whole word sequence as its one shingle.  Equal
shingles get equal numbers; unequal ones get unequal numbers but for a chance of
about 2^-64 for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SIZE = 5
#: Bytes of text that are worked on at once (a longer text is worked on alone).
CHUNK = 1 << 18

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# a number for each byte, A-Z like a-z
_SYMBOL = mix(np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64) + _GOLDEN)
_BASE = np.uint64(0xD1342543DE82EF95)


def _powers(n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = _BASE
        np.multiply.accumulate(out, out=out)
    return out


def word_numbers(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words of texts laid end to end, and the text of each word.

    ``edges`` holds the start of every text and the end of the last.
    """
    letter = ~_BLANK[data]
    inside = np.zeros(len(data) + 1, bool)
    inside[: len(data)] = letter
    before = np.zeros(len(data) + 1, bool)
    before[1:] = letter
    before[edges] = False  # a text's first byte follows nothing
    starts = np.nonzero(inside & ~before)[0]
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    at = np.nonzero(letter)[0]
    ends_here = np.zeros(len(data) + 1, bool)
    ends_here[starts] = True
    word_of = np.cumsum(ends_here[at]) - 1
    place = at - starts[word_of]
    sizes = np.bincount(word_of)
    terms = _SYMBOL[data[at]] * _powers(int(sizes.max()))[place]
    first = np.searchsorted(at, starts)
    numbers = mix(np.add.reduceat(terms, first) + sizes.astype(np.uint64) * _GOLDEN)
    return numbers, np.searchsorted(edges, starts, side="right") - 1


def sequences(numbers: np.ndarray, size: int) -> np.ndarray:
    """Numbers of all runs of ``size`` consecutive words."""
    n = len(numbers) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = mix(out * _BASE + numbers[k : k + n])
    return out


def texts_in(column, chunk: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Chunks of a text column: (first row, bytes, edges); null texts are empty."""
    chunk = chunk or CHUNK
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    edges = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    whole = column.buffers()[2]
    data = np.frombuffer(whole, np.uint8) if whole is not None else np.empty(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(edges, edges[row] + chunk, side="right")) - 1)
        yield row, data[edges[row] : edges[stop]], edges[row : stop + 1] - edges[row]
        row = stop


def shingles_of(data: np.ndarray, edges: np.ndarray, size: int = SIZE) -> Iterator[np.ndarray]:
    """The shingles of each text in order of place, repeats included."""
    numbers, text_of = word_numbers(data, edges)
    bounds = np.searchsorted(text_of, np.arange(len(edges)))
    every = sequences(numbers, size) if len(numbers) >= size else None
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= size:
            yield every[a : b - size + 1]
        elif b > a:
            yield sequences(numbers[a:b], b - a)
        else:
            yield np.empty(0, np.uint64)
