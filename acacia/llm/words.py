"""Words of UTF-8 texts as numpy arrays: spans, counts per text and 64-bit hashes.

Two word definitions are used by the operators: runs of ASCII letters and digits and of all
non-ASCII characters, after lower-casing A-Z (``ALNUM``), and runs of anything but ASCII white
space (``SPACED``). Both can be decided byte by byte, since every byte of a non-ASCII character is
above 0x7F.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_BYTES = np.arange(256, dtype=np.uint8)
IS_ALNUM = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x41) & (_BYTES <= 0x5A)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
IS_SPACED = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)
#: For bytes.translate: lower case, and a space for everything outside ALNUM words.
ALNUM_TABLE = np.where(IS_ALNUM, LOWER, 0x20).astype(np.uint8).tobytes()

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: The low bytes of eight that belong to a word of which so many are left.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Words of more bytes are hashed one by one.
_LONG = 64


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every input bit."""
    h = h.copy()
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit name for ordered pairs of 64-bit values."""
    return mixed(a * np.uint64(0xD6E8FEB86659FD93) + (b ^ np.uint64(0xA0761D6478BD642F)))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and where each text starts (and the last ends)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def pieces(batch: pa.RecordBatch, column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of text, a row at least, so that arrays over all words stay small."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    part = np.cumsum(lengths) // most
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else []
    for a, b in zip(first, [*first[1:], len(part)], strict=True):
        yield batch.slice(int(a), int(b - a))


class Words:
    """Spans of the words of several texts, in order.

    ``start``/``end``: byte offsets into ``data``; ``first``: index of each text's first word, with
    the total as a last entry.
    """

    def __init__(self, column: pa.Array, is_word: np.ndarray, lower: bool):
        data, at = flat(column)
        self.data = LOWER[data] if lower else data
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = is_word[data]
        begins = inside[1:-1] & ~inside[:-2]
        ends = inside[1:-1] & ~inside[2:]
        edge = at[:-1][at[:-1] < len(data)]
        begins[edge] |= inside[1:-1][edge]
        edge = edge[edge > 0]
        ends[edge - 1] |= inside[1:-1][edge - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, at)

    def __len__(self) -> int:
        return len(self.start)

    def text_of(self) -> np.ndarray:
        """The index of each word's text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's length and bytes. Every eight bytes are mixed in by a bijection, so that words of up to eight bytes of one length never collide."""
        size = self.end - self.start
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eights = np.ndarray(len(self.data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each byte on
        out = mixed((size.astype(np.uint64) + np.uint64(seed << 40)) * _ODD)
        on, at = np.flatnonzero(size <= _LONG), 0
        while len(on):
            left = size[on] - at
            out[on] = mixed(out[on] ^ (eights[self.start[on] + at] & _MASKS[np.minimum(left, 8)]))
            on, at = on[left > 8], at + 8
        for i in np.flatnonzero(size > _LONG).tolist():
            out[i] ^= np.uint64(xxhash.xxh64_intdigest(self.data[self.start[i] : self.end[i]].tobytes(), seed))
        return out

    def joined(self, which: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Some words with one space after each, and where each of them starts."""
        size = self.end[which] - self.start[which]
        start = np.cumsum(size + 1) - (size + 1)
        total = int(size.sum())
        out = np.full(total + len(which), 0x20, np.uint8)
        inside = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(start, size) + inside] = self.data[np.repeat(self.start[which], size) + inside]
        return out.tobytes(), start


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each list."""
    ends = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))
