"""Language ID: multinomial naive Bayes over hashed character n-grams.

Texts become code points: letters in lower case, everything else a space. All
1- to 3-grams are hashed to `BUCKETS` columns. Counting is one pass over the
labelled texts, summed by (language, column) in Spark; the matrix of log
probabilities has `languages * BUCKETS` numbers, goes to the executors as a
broadcast, and every batch of texts is scored in numpy one language at a time.

Defined results: `und` with score 0 for a text that is null, empty or holds no
letter, or if there is nothing to learn from; ties go to the language that sorts
first; a label of null or "" is no label. More than `MAX_LANGUAGES` labels raise
ValueError, since the matrix is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinia.llm.words import mix, pieces, utf8

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
MAX_LANGUAGES = 2000
UNKNOWN = "und"
# A character takes some 100 bytes while its n-grams are looked up.
PIECE_BYTES = 1_500_000


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """Per code point: its lower case if it is a letter, else a space."""
    out = np.full(0x110000, 0x20, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def grams(texts: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each order the columns of all n-grams and where each text's n-grams begin; whether a text has a letter."""
    data, borders = utf8(texts)
    heads = (data & 0xC0) != 0x80  # first bytes of characters
    at = np.concatenate([[0], np.cumsum(heads)])[borders]
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    points = _folded()[np.minimum(points, 0x10FFFF)]
    letters = np.concatenate([[0], np.cumsum(points != 0x20)])[at]
    doc = np.repeat(np.arange(len(borders) - 1), np.diff(at))
    out = []
    for n in ORDERS:
        size = max(0, len(points) - n + 1)
        key = points[:size].astype(np.uint64)
        for j in range(1, n):
            key = key * np.uint64(0x1FFFFF) + points[j : size + j]
        one_text = doc[:size] == doc[n - 1 :] if size else np.zeros(0, bool)
        column = (mix(key + np.uint64(n)) & np.uint64(BUCKETS - 1)).astype(np.int32)
        out.append((column[one_text], np.searchsorted(doc[:size][one_text], np.arange(len(borders)))))
    return out, np.diff(letters) > 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, total in totals.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(total[used], pa.int64())],
                ["lang", "bucket", "n"],
            )
        totals.clear()

    for batch in pieces(batches, "text", PIECE_BYTES):
        found, _ = grams(batch.column("text"))
        langs = batch.column("lang").dictionary_encode()
        names, code = langs.dictionary.to_pylist(), langs.indices.to_numpy()
        for k, name in enumerate(names):
            if len(totals) > 200 and name not in totals:
                yield from flush()
            total = totals.setdefault(name, np.zeros(BUCKETS, np.int64))
            for column, at in found:
                mine = np.repeat(code == k, np.diff(at))
                total += np.bincount(column[mine], minlength=BUCKETS)
    yield from flush()


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order, and log probabilities [language, column] with add-one smoothing."""
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = (
        rows.where("lang <> '' and text <> ''")
        .mapInArrow(_count, "lang string, bucket int, n bigint")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
        .groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("row"))  # at most BUCKETS entries
    )
    found = counts.orderBy("lang").limit(MAX_LANGUAGES + 1).toArrow()
    if found.num_rows > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    names = found["lang"].to_pylist()
    logs = np.ones((len(names), BUCKETS))
    for k, row in enumerate(found["row"].chunks and found["row"].combine_chunks() or []):
        flat = row.values
        logs[k, flat.field("bucket").to_numpy()] += flat.field("n").to_numpy()
    return names, np.log(logs / logs.sum(axis=1, keepdims=True)) if names else logs


def score(texts: pa.Array, names: list[str], logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the likeliest language (-1: none) and its posterior probability."""
    found, has_letter = grams(texts)
    total = np.zeros((len(names), len(texts)))
    for k in range(len(names)):
        for column, at in found:
            sums = np.concatenate([[0.0], np.cumsum(logs[k][column])])
            total[k] += sums[at[1:]] - sums[at[:-1]]
    if not names:
        return np.full(len(texts), -1), np.zeros(len(texts))
    total /= len(ORDERS)  # every character counts once, not once per order
    best = total.argmax(axis=0)
    sure = 1 / np.exp(total - total.max(axis=0)).sum(axis=0)
    return np.where(has_letter, best, -1), np.where(has_letter, np.clip(sure, 0.0, 1.0), 0.0)


def predictor(spark, names: list[str], logs: np.ndarray):
    """Column function: text -> struct(lang_pred, score), with the matrix as a broadcast."""
    shared = spark.sparkContext.broadcast(logs)

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predict(texts: pa.Array) -> pa.Array:
        langs, scores = [], []
        for part in pieces([pa.RecordBatch.from_arrays([texts], ["t"])], "t", PIECE_BYTES):
            best, sure = score(part.column("t"), names, shared.value)
            langs += [names[i] if i >= 0 else UNKNOWN for i in best]
            scores.append(sure)
        flat = np.concatenate(scores) if scores else np.zeros(0)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(flat, pa.float64())], ["lang_pred", "score"])

    return predict


def held_out(id_col: str = "doc_id") -> Column:
    """Every fifth id by its CRC; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0, F.lit(False))


def identify(
    docs: DataFrame, train: DataFrame | None = None, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
    out_col: str = "_language",
) -> DataFrame:
    """All rows and columns of `docs`, and `out_col` = struct(lang_pred, score), in place of a column of that name.

    Learns from `train`, or else from the rows of `docs` that are not held out.
    """
    names, logs = fit(train if train is not None else docs.where(~held_out(id_col)), text_col, lang_col)
    return docs.withColumn(out_col, predictor(docs.sparkSession, names, logs)(F.col(text_col)))
