"""Words and their hashes for a whole Arrow batch at a time, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: Bytes of text worked on at once; a longer text goes alone.
CHUNK = 1 << 20

_ASCII = np.arange(256)
#: Bytes that end a word: ASCII white space; for letters_only, all ASCII but letters and digits.
WHITE = np.isin(_ASCII, [32, *range(9, 14)])
LETTERS = ~((_ASCII >= 128) | ((_ASCII >= 48) & (_ASCII <= 57)) | ((_ASCII >= 65) & (_ASCII <= 90)) | ((_ASCII >= 97) & (_ASCII <= 122)))
LOWER = np.where((_ASCII >= 65) & (_ASCII <= 90), _ASCII + 32, _ASCII).astype(np.uint8)

_powers: dict[int, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX1)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(MIX2)
        return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. n-1 modulo 2 ** 64; longer tables than a few chunks are not kept."""
    if base not in _powers or n > len(_powers[base]):
        out = np.full(max(n, CHUNK), base, np.uint64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        if n > 4 * CHUNK:
            return out
        _powers[base] = out
    return _powers[base]


def spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE) -> np.ndarray:
    """A hash of each values[start:end], by prefix sums of a polynomial modulo 2 ** 64."""
    n = len(values)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values.astype(np.uint64) * powers(base, n)[:n], out=sums[1:])
        back = powers(pow(base, -1, 1 << 64), n)
        return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64) * np.uint64(MIX1))


class Texts:
    """Some texts end to end: data (bytes), offsets of the texts, starts and ends of words, bounds of each text's words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = WHITE):
        self.data, self.offsets = data, offsets
        word = ~apart[data]
        first = word.copy()
        first[1:] &= ~word[:-1]
        last = word.copy()
        last[:-1] &= ~word[1:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        first[inner] = word[inner]  # a text's start or end also bounds a word
        last[inner - 1] = word[inner - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def owners(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self)), self.counts())

    def hashes(self, lower: bool = False) -> np.ndarray:
        return spans((LOWER[self.data] if lower else self.data).astype(np.uint64) + np.uint64(1), self.starts, self.ends)


def texts(column: pa.Array, apart: np.ndarray = WHITE, chunk: int = CHUNK) -> Iterator[tuple[slice, Texts]]:
    """The column's rows in runs of about ``chunk`` bytes. A null is an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + chunk, "right")) - 1)
        yield slice(at, to), Texts(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], apart)
        at = to
