"""Best-fit packing of token sequences, in bulk-synchronous steps.

Documents become ids, end with id 1, and only those longer than the capacity are
cut. Pieces of one length are interchangeable, and so are sequences with one gap,
so documents and gaps are range-sorted by size and handled in bulk: a step takes
all pieces of a length, longest first, and sweeps the gaps from the smallest one
that is large enough (its successor) upwards; where more sequences or pieces
want the same place, their rank within the size decides; the gaps are updated
and the next length follows. That is best-fit decreasing, in `capacity` steps
whatever the number of documents: the state of a step is a count per size, which
the capacity bounds. Spark tokenises, counts per length, ranks the pieces of a
length over all tasks, and places every piece by its length and rank.

Defined results: a null or empty text is the single end id; repeated rows are
packed once each; null ids are kept as null; an empty table gives no pieces.
Only the id and text columns are read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinia.llm.words import WHITE, pieces, utf8, words_of
from affinia.session import materialise

CAPACITY = 4096
END = 1
# Words whose ids a Python worker remembers; white space separates words for these tokenizers.
REMEMBERED = 1_500_000
# New words are encoded some at a time, each followed by a mark that stands alone and has an id of its own.
TOGETHER, MARK = 64, b"\x1e"


class WordIds:
    """Token ids of words: every different word is encoded once while it is remembered."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        mark = self._encode(MARK)
        self.mark = mark[0] if len(mark) == 1 else None
        self._clear()

    def _clear(self) -> None:
        self.known, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.begin, self.flat = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _encode(self, word: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)

    def _encode_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in a row and their number for each word."""
        if self.mark is not None:
            ids = self._encode(b"".join(w + b" " + MARK + b" " for w in words))
            at = np.flatnonzero(ids == self.mark)
            if len(at) == len(words):  # else a word holds the mark itself
                return np.delete(ids, at), np.diff(at, prepend=-1) - 1
        each = [self._encode(w) for w in words]
        return np.concatenate(each), np.array([len(ids) for ids in each], np.int64)

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """Encode words that are not known, in ascending order of their hashes."""
        got = [self._encode_all(words[i : i + TOGETHER]) for i in range(0, len(words), TOGETHER)]
        flat, size = (np.concatenate(x) for x in zip(*got))
        slots = np.arange(len(size)) + len(self.begin) - 1
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(size)])
        self.flat = np.concatenate([self.flat, flat])
        places = np.searchsorted(self.known, hashes)
        self.known, self.slot = np.insert(self.known, places, hashes), np.insert(self.slot, places, slots)

    def ids(self, data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the n + 1 borders between the texts."""
        words = words_of(data, borders, WHITE)
        different, at, back = np.unique(words.hash, return_index=True, return_inverse=True)
        if len(self.known) + len(different) > REMEMBERED:
            self._clear()
        near = np.minimum(np.searchsorted(self.known, different), max(len(self.known) - 1, 0))
        new = self.known[near] != different if len(self.known) else np.ones(len(different), bool)
        if new.any():
            places = at[new]
            self._learn(different[new], [data[a:b].tobytes() for a, b in zip(words.start[places], words.end[places])])
        slot = self.slot[np.searchsorted(self.known, different)][back]
        begin, size = self.begin[slot], self.begin[slot + 1] - self.begin[slot]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(begin - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.concatenate([[0], ends])[words.first]


_WORD_IDS: dict[str, WordIds] = {}


def cut(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(_id, piece, start, length, ids_crc32, task, rank): `rank` counts pieces of one length in a task from 0."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _WORD_IDS.setdefault(tokenizer_path, None) or WordIds(tokenizer_path)
        _WORD_IDS[tokenizer_path] = encoder
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in pieces(batches, "_text"):
            ids, borders = encoder.ids(*utf8(batch.column("_text")))
            row, piece, start, length, crc, rank = [], [], [], [], [], []
            for d in range(batch.num_rows):
                own = np.append(ids[borders[d] : borders[d + 1]], END).astype("<u4")
                for k, at in enumerate(range(0, len(own), capacity)):
                    part = own[at : at + capacity]
                    row.append(d)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    rank.append(seen[len(part)])
                    seen[len(part)] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id").take(pa.array(row, pa.int64())),
                    pa.array(piece, pa.int32()),
                    *(pa.array(x, pa.int64()) for x in (start, length, crc)),
                    pa.array([task] * len(row), pa.int32()),
                    pa.array(rank, pa.int64()),
                ],
                ["_id", "piece", "start", "length", "ids_crc32", "task", "rank"],
            )

    ddl = "piece int, start bigint, length bigint, ids_crc32 bigint, task int, rank bigint"
    return rows.mapInArrow(scan, T.StructType([rows.schema["_id"], *T.StructType.fromDDL(ddl).fields]))


@dataclass
class Placement:
    """Runs of equal placements, sorted by length and rank: pieces `rank`.. of `length` go `per` to a sequence."""

    length: np.ndarray
    rank: np.ndarray
    per: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces with these lengths and ranks."""
        step = np.int64(1) << 48
        run = np.searchsorted(self.length * step + self.rank, length * step + rank, side="right") - 1
        within = rank - self.rank[run]
        return self.sequence[run] + within // self.per[run], self.offset[run] + within % self.per[run] * length


def best_fit(counts: np.ndarray) -> Placement:
    """Place counts[n] pieces of every length n into sequences of capacity len(counts) - 1, longest first."""
    capacity = len(counts) - 1
    gaps: list[int] = []  # sizes of open gaps in order
    held: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, sequences)
    runs, fresh = [], 0

    def open_gap(size: int, first: int, n: int) -> None:
        if size and n:
            if size not in held:
                insort(gaps, size)
                held[size] = []
            held[size].append((first, n))

    for length in range(capacity, 0, -1):
        left, rank = int(counts[length]), 0
        while left:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                n = -(-left // (capacity // length))
                open_gap(capacity, fresh, n)
                fresh += n
                continue
            size = gaps[at]
            first, n = held[size].pop()
            if not held[size]:
                del held[size], gaps[at]
            per = size // length
            full = min(n, left // per)
            some = left - full * per if full < n else 0
            if full:
                runs.append((length, rank, per, first, capacity - size))
                open_gap(size - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            if some:
                runs.append((length, rank, some, first + full, capacity - size))
                open_gap(size - some * length, first + full, 1)
                rank, left, full = rank + some, left - some, full + 1
            open_gap(size, first + full, n - full)
    return Placement(*(np.array(x, np.int64) for x in zip(*sorted(runs)))) if runs else Placement(*np.zeros((5, 0), np.int64))


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    spark = docs.sparkSession
    cut_docs = materialise(cut(docs, tokenizer_path, id_col, text_col, capacity), "pieces")
    per_task = cut_docs.groupBy("length", "task").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for row in per_task.groupBy("length").agg(F.sum("n").alias("n")).toLocalIterator():  # at most `capacity` rows
        counts[row["length"]] = row["n"]
    placement = spark.sparkContext.broadcast(best_fit(counts))
    earlier = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    before = per_task.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))

    @F.arrow_udf("struct<sequence_id: bigint, offset: bigint>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        sequence, offset = placement.value.place(length.to_numpy(), rank.to_numpy())
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], ["sequence_id", "offset"])

    return (
        cut_docs.join(before, ["length", "task"])
        .withColumn("_at", place(F.col("length"), F.col("rank") + F.col("before")))
        .select(F.col("_id").alias(id_col), "piece", "start", "length", "ids_crc32", "_at.sequence_id", "_at.offset")
    )
