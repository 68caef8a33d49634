"""Word positions and word hashes of whole texts, in numpy over Arrow buffers.

The functions work on the UTF-8 bytes of a batch of texts. All separators used
here are ASCII, so a byte is a separator exactly if its character is one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Texts are looked at in pieces of about this many bytes; a longer text is a piece of its own.
PIECE_BYTES = 4_000_000
LONG_WORD = 512

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

NOT_ALNUM = np.zeros(256, dtype=bool)  # of ASCII; every byte above 0x7F belongs to a word
NOT_ALNUM[:128] = [not chr(i).isalnum() for i in range(128)]

_MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_S32, _S29 = np.uint64(32), np.uint64(29)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijection of 64-bit numbers whose output bits depend on all input bits."""
    x = (x ^ (x >> _S32)) * _B
    x ^= x >> _S29
    x *= _A
    x ^= x >> _S32
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row and the n + 1 borders between them; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, borders, data = column.buffers()
    borders = np.frombuffer(borders, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[borders[0] : borders[-1]], borders - borders[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, cut so that the texts of a batch stay near `limit` bytes."""
    limit = limit or PIECE_BYTES
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(size), 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, upto - at)
            at = upto


@dataclass
class Words:
    """Words of a batch: byte borders, index of the text, and a 64-bit hash each."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # index of each text's first word, and the number of words at the end

    def rolling(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of each first word of k consecutive words of one text, and the hash of the k words."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        total = self.hash[:n].copy()
        for j in range(1, k):
            total *= _STEP
            total += self.hash[j : n + j]
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return at, mix(total[at])


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range, eight bytes a step."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(data) + 1,), (1,))
    left = end - start
    out = mix(left.astype(np.uint64) + _A)
    live = np.flatnonzero((left > 0) & (left <= LONG_WORD))
    at, left = start[live], left[live]
    while live.size:
        out[live] = mix(out[live] ^ (eight[at] & _MASK[np.minimum(left, 8)]))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(end - start > LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def words_of(data: np.ndarray, borders: np.ndarray, separators: np.ndarray) -> Words:
    """Words between separators; a word never crosses from one text to the next."""
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[1:] = ~separators[data]
    edge = inside[1:] != inside[:-1]
    # two texts may touch without a separator: open a word at the border as well
    marks = np.flatnonzero(edge)
    fresh = borders[1:-1]
    fresh = fresh[(fresh > 0) & (fresh < len(data))]
    fresh = np.unique(fresh[inside[fresh] & inside[fresh + 1]]) if fresh.size else fresh
    opens = np.flatnonzero(edge & inside[1:])
    closes = marks[~inside[1:][marks]]
    if len(data) and inside[-1]:
        closes = np.append(closes, len(data))
    start = np.sort(np.concatenate([opens, fresh]))
    end = np.sort(np.concatenate([closes, fresh]))
    doc = np.searchsorted(borders[1:], start, side="right")
    first = np.searchsorted(start, borders, side="left")
    return Words(start, end, doc, hash_ranges(data, start, end), first)
