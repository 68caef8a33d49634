"""Benchmark decontamination by greedy string tiling.

Benchmark items become word hashes; every `MIN_MATCH` consecutive words of an
item are a seed. Documents are scanned against the seeds of one block of items
at a time (a block's text has a bounded size, so it can be a broadcast; a larger
benchmark takes more blocks). Where document and item share seeds, the longest
common stretch that is still unmarked on both sides is found with Karp-Rabin
window hashes and marked, and again, until nothing of `MIN_MATCH` words is left.
Tiles may stand in any order, so a passage with moved sentences is caught. A
pair is a leak if the tiles cover at least `threshold` of the item's words.

Words are what separates at ASCII characters other than letters and digits, with
A-Z in lower case. Defined results: null and empty texts hold no words; items
shorter than `MIN_MATCH` words have no seed and never match; repeated documents
give a row each, repeated items count once; empty tables give an empty table.
Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinia.llm.words import LOWER, NOT_ALNUM, pieces, utf8, words_of

MIN_MATCH = 5
THRESHOLD = 0.6
BLOCK_CHARS = 16_000_000

SPANS = pa.list_(pa.struct([("doc_word", pa.int64()), ("item_word", pa.int64()), ("words", pa.int64())]))
FOUND = (
    "n_tiles bigint, covered bigint, item_words bigint, coverage double, "
    "spans array<struct<doc_word: bigint, item_word: bigint, words: bigint>>"
)

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class _Windows:
    """Karp-Rabin hashes of all unmarked windows of a word sequence."""

    def __init__(self, words: np.ndarray, closed: np.ndarray) -> None:
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers(_BASE, len(words)), dtype=np.uint64)])
        self.back = _powers(_INVERSE, len(words))
        self.closed = closed.copy()

    def of(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.closed) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        marks = np.concatenate([[0], np.cumsum(self.closed)])
        at = np.flatnonzero(marks[size:] == marks[:n])
        return at, (self.sums[at + size] - self.sums[at]) * self.back[at]


def tiles(item: np.ndarray, text: np.ndarray, closed: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """(place in the item, place in the text, length) of greedy tiles; `closed` words of the text match nothing."""
    a, b = _Windows(item, np.zeros(len(item), bool)), _Windows(text, closed)

    def shared(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        (i, x), (j, y) = a.of(size), b.of(size)
        return i, x, j, y

    out, high = [], min(len(item), len(text))
    while high >= min_match:
        low, best = min_match, 0
        while low <= high:  # a common stretch of n words holds one of n - 1, so the longest can be bisected
            mid = (low + high) // 2
            _, x, _, y = shared(mid)
            if np.isin(x, y).any():
                best, low = mid, mid + 1
            else:
                high = mid - 1
        if not best:
            break
        i, x, j, y = shared(best)
        where: dict[int, list[int]] = {}
        for p, h in zip(j[::-1].tolist(), y[::-1].tolist()):
            where.setdefault(h, []).append(p)
        for p, h in zip(i.tolist(), x.tolist()):
            places = where.get(h, [])
            if a.closed[p : p + best].any():
                continue
            while places:
                q = places.pop()
                if not b.closed[q : q + best].any():
                    a.closed[p : p + best] = b.closed[q : q + best] = True
                    out.append((p, q, best))
                    break
        high = best
    return out


def _items(rows: list, min_match: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Sorted seed hashes with the index and position of their item, and each item's words."""
    data, borders = utf8(pa.array([r["_text"] for r in rows], pa.string()))
    words = words_of(LOWER[data], borders, NOT_ALNUM)
    at, seeds = words.rolling(min_match)
    order = np.argsort(seeds, kind="stable")
    each = [words.hash[words.first[k] : words.first[k + 1]] for k in range(len(rows))]
    return seeds[order], words.doc[at[order]], (at - words.first[words.doc[at]])[order], each


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_chars: int) -> Iterator[list]:
    items = benchmark.select(F.col(item_col).alias("_item"), F.col(text_col).alias("_text")).where(F.length("_text") > 0).distinct()
    chars = items.agg(F.sum(F.length("_text"))).first()[0] or 0
    n = -(-chars // block_chars)
    for k in range(n):
        yield items.where(F.pmod(F.xxhash64("_item", "_text"), F.lit(n)) == k).orderBy("_item", "_text").collect()


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    min_match: int = MIN_MATCH,
    threshold: float = THRESHOLD,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(doc id, item id, n_tiles, covered, item_words, coverage, spans) of every leaked pair.

    `spans` lists the tiles: first word in the document, first word in the item, words.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    found_type = T.StructType([rows.schema["_id"], *T.StructType.fromDDL(f"_item int, {FOUND}").fields])
    found_names = found_type.names[2:]
    item_type = benchmark.schema[item_col].dataType
    columns = [F.col("_id").alias(id_col), F.col(item_col), *found_names]
    no_items = spark.createDataFrame([], T.StructType([found_type["_item"], T.StructField(item_col, item_type)]))
    out = spark.createDataFrame([], found_type).join(no_items, "_item").select(*columns)
    for block in _blocks(benchmark, item_col, item_text_col, block_chars):
        shared = spark.sparkContext.broadcast(_items(block, min_match))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            seeds, owner, place, each = shared.value
            known = np.unique(seeds)
            for batch in pieces(batches, "_text"):
                data, borders = utf8(batch.column("_text"))
                words = words_of(LOWER[data], borders, NOT_ALNUM)
                at, got = words.rolling(min_match)
                near = np.searchsorted(known, got)
                hit = known[np.minimum(near, len(known) - 1)] == got if len(known) else np.zeros(len(got), bool)
                at, got = at[hit], got[hit]
                doc = words.doc[at]
                found = []
                for d in np.unique(doc):
                    mine, first = got[doc == d], words.first[d]
                    places = at[doc == d] - first
                    text = words.hash[first : words.first[d + 1]]
                    some = np.unique(mine)
                    low, high = np.searchsorted(seeds, some), np.searchsorted(seeds, some, side="right")
                    listed = np.concatenate([np.arange(x, y) for x, y in zip(low, high)])
                    for k in np.unique(owner[listed]):
                        item = each[k]
                        of_item = listed[owner[listed] == k]
                        reach = np.zeros(len(item) + 1, np.int64)  # words that some shared seed covers
                        np.add.at(reach, place[of_item], 1)
                        np.add.at(reach, np.minimum(place[of_item] + min_match, len(item)), -1)
                        if (np.cumsum(reach[:-1]) > 0).sum() < threshold * len(item):
                            continue
                        open_ = np.zeros(len(text) + 1, np.int64)
                        own = places[np.isin(mine, seeds[of_item])]
                        np.add.at(open_, own, 1)
                        np.add.at(open_, own + min_match, -1)
                        closed = np.cumsum(open_[:-1]) <= 0
                        lo, hi = int(own.min()), int(own.max()) + min_match
                        got_tiles = tiles(item, text[lo:hi], closed[lo:hi], min_match)
                        covered = sum(t[2] for t in got_tiles)
                        if covered >= threshold * len(item):
                            spans = [{"doc_word": q + lo, "item_word": p, "words": n} for p, q, n in sorted(got_tiles)]
                            found.append((int(d), int(k), len(spans), covered, len(item), covered / len(item), spans))
                if found:
                    cols = list(zip(*found))
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("_id").take(pa.array(cols[0], pa.int64())),
                            pa.array(cols[1], pa.int32()),
                            *(pa.array(c, pa.int64()) for c in cols[2:5]),
                            pa.array(cols[5], pa.float64()),
                            pa.array(cols[6], SPANS),
                        ],
                        found_type.names,
                    )

        # one row per item of the block, whose size is bounded
        names = spark.createDataFrame([(k, r["_item"]) for k, r in enumerate(block)], no_items.schema)
        out = out.unionByName(rows.mapInArrow(scan, found_type).join(F.broadcast(names), "_item").select(*columns))
    return out
