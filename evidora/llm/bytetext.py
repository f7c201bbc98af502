"""Vectorised byte-level views of Arrow text columns.

Everything here works on whole texts as UTF-8 bytes.  A null text is read as
an empty one.  Texts are handled in blocks of half a megabyte, so that the
memory a task needs depends on its longest single text and not on its batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_POWER_BITS = 16


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise over uint64."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        if not x.ndim:
            return splitmix(x[None] - np.uint64(0x9E3779B97F4A7C15))[0]
        shifted = x >> np.uint64(30)
        x ^= shifted
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= np.right_shift(x, np.uint64(27), out=shifted)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= np.right_shift(x, np.uint64(31), out=shifted)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants made from a seed."""
    return splitmix(np.arange(n, dtype=np.uint64) + np.uint64(seed << 20)) | np.uint64(1)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


_BYTE_CODES = constants(256, 11)
_POWERS = powers(0x9E3779B97F4A7C15 | 1, 1 << _POWER_BITS)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `most` bytes of text each (one row at least)."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


class WordClass:
    """Which bytes belong to words; a word is a maximal run of them in one text."""

    def __init__(self, is_word: np.ndarray):
        self.is_word = is_word
        self.codes = np.where(is_word, _BYTE_CODES, np.uint64(0))


_NOT_SPACE = np.ones(256, dtype=bool)
_NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: ``[^\x20\x09-\x0D]+``
NOT_SPACE = WordClass(_NOT_SPACE)

_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[0x30:0x3A] = _ALNUM[0x61:0x7B] = _ALNUM[0x80:] = True
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z
ALNUM = WordClass(_ALNUM)


def words(data: np.ndarray, offsets: np.ndarray, kind: WordClass, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, number of words of each text) of every word, with A-Z lower-cased unless told otherwise.

    Equal words have equal 64-bit hashes; words never cross texts.
    """
    n_texts = len(offsets) - 1
    nothing = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n_texts, np.int64)
    if not len(data):
        return nothing
    low = LOWER[data] if lower else data
    inside = kind.is_word[low]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    text_starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[text_starts] = inside[text_starts]
    starts = np.flatnonzero(first)
    if not len(starts):
        return nothing
    ending = inside.copy()
    ending[:-1] &= ~inside[1:] | first[1:]
    ends = np.flatnonzero(ending) + 1
    at = np.arange(starts[0], len(low))
    at -= np.repeat(starts, np.diff(starts, append=len(low)))
    values = kind.codes[low[starts[0] :]]
    values *= _POWERS[at & ((1 << _POWER_BITS) - 1)]
    if (ends - starts).max() > 1 << _POWER_BITS:
        values *= (2 * (at >> _POWER_BITS) + 1).astype(np.uint64)
    hashes = np.add.reduceat(values, starts - starts[0])
    hashes = splitmix(hashes + (ends - starts).astype(np.uint64))
    counts = np.diff(np.searchsorted(starts, offsets))
    return hashes, starts, ends, counts


def shingles(hashes: np.ndarray, counts: np.ndarray, size: int) -> list[np.ndarray]:
    """The distinct hashed word shingles of each text, sorted.

    A text of fewer words than `size` has its whole sequence as one shingle,
    and a text without words has none.
    """
    factors = constants(size, 23)
    n = len(hashes)
    rolled = np.zeros(max(0, n - size + 1), np.uint64)
    for k in range(size):
        rolled += hashes[k : k + len(rolled)] * factors[k]
    rolled = splitmix(rolled)
    out, at = [], 0
    for count in counts.tolist():
        if count >= size:
            out.append(np.unique(rolled[at : at + count - size + 1]))
        elif count:
            whole = (hashes[at : at + count] * factors[:count]).sum(dtype=np.uint64) + np.uint64(count)
            out.append(splitmix(np.array([whole])))
        else:
            out.append(np.zeros(0, np.uint64))
        at += count
    return out


def rolling(data: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A 64-bit hash of every run of `size` bytes, by doubling; of length len(data) - size + 1."""
    if len(data) < size:
        return np.zeros(0, np.uint64)
    base = int(constants(1, seed)[0])
    have = constants(256, seed + 1)[data]
    width, out, done, rest = 1, None, 0, size
    while True:
        if rest & 1:
            if out is None:
                out = have
            else:  # what there is so far, then `width` more bytes
                n = len(data) - (done + width) + 1
                out = out[:n] * np.uint64(pow(base, width, 1 << 64))
                out += have[done : done + n]
            done += width
        rest >>= 1
        if not rest:
            return splitmix(out[: len(data) - size + 1])
        n = len(data) - 2 * width + 1
        ahead = have[width : width + n]
        have = have[:n] * np.uint64(pow(base, width, 1 << 64))
        have += ahead
        width *= 2


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every run of `width` values."""
    have, size = values, 1
    while 2 * size <= width:
        have = np.minimum(have[: len(have) - size], have[size:])
        size *= 2
    if size < width:
        have = np.minimum(have[: len(values) - width + 1], have[width - size : len(values) - size + 1])
    return have
