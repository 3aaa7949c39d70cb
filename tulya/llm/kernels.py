"""Array code over whole Arrow batches of text: words, hashes and shingles.

A text is taken as its UTF-8 bytes. Every separator used here is an ASCII byte
and no byte of a longer character is one, so cutting bytes equals cutting
characters. Hashes are 64 bits wide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes worked on at a time; a longer text is a piece of its own.
PIECE = 1 << 20

_BASE = U64(0x9E3779B97F4A7C15)
_STEP = U64(0xD6E8FEB86659FD93)

#: A-Z to a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words that end at blanks only.
BLANK_WORDS = np.ones(256, dtype=bool)
BLANK_WORDS[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of words made of a-z, 0-9 and whatever is not ASCII (after LOWER).
PLAIN_WORDS = np.zeros(256, dtype=bool)
PLAIN_WORDS[0x30:0x3A] = PLAIN_WORDS[0x61:0x7B] = PLAIN_WORDS[0x80:] = True


#: The first 0 to 8 bytes of a little-endian number.
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=U64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on each other."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null is empty."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    _, where, what = column.buffers()
    off = np.frombuffer(where, np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(what, np.uint8)[off[0] : off[-1]] if what is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, end row, bytes and offsets of runs of rows of about PIECE bytes."""
    data, off = buffers(column)
    n, at = len(off) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + PIECE, side="right")) - 1)
        yield at, end, data[off[at] : off[end]], off[at : end + 1] - off[at]
        at = end


class Words:
    """Words of a piece: starts, ends, row of each, and rows' first word (one more than rows)."""

    def __init__(self, data: np.ndarray, off: np.ndarray, is_word: np.ndarray, lower: bool = True):
        self.data = LOWER[data] if lower else data
        self.off = off
        inside = is_word[self.data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[off] = True
        before = np.zeros_like(inside)
        before[1:] = inside[:-1]
        after = np.zeros_like(inside)
        after[:-1] = inside[1:]
        self.starts = np.flatnonzero(inside & (~before | edge[:-1]))
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, off)
        self.row = np.repeat(np.arange(len(off) - 1), np.diff(self.first))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A hash of each word's bytes, eight bytes at a time."""
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(self.data) + 1, "<u8", padded, strides=(1,))
        length = self.ends - self.starts
        out = (eight[self.starts] & _MASK[np.minimum(length, 8)]) * _BASE + length.astype(U64) * _STEP
        out ^= out >> U64(29)
        more = np.flatnonzero(length > 8)
        done = 8
        while len(more):
            value = eight[self.starts[more] + done] & _MASK[np.minimum(length[more] - done, 8)]
            kept = mix(out[more] + value * _BASE)
            out[more] = kept
            done += 8
            more = more[length[more] > done]
        return mix(out)


def shingles(words: Words, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word and hash of every k consecutive words of one row."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    at = np.flatnonzero(words.row[:n] == words.row[k - 1 :])
    total = hashes[at].copy()
    for j in range(1, k):
        total = total * _STEP + hashes[at + j]
    return at, mix(total + U64(k))


def bitmap_has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the keys may be in a set kept as a bitmap of uint64."""
    where = keys & U64(len(bits) * 64 - 1)
    return (bits[(where >> U64(6)).astype(np.int64)] >> (where & U64(63))) & U64(1) != 0
