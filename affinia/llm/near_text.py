"""Near-duplicate documents by SetSketch registers.

A document is the set of its distinct shingles. Its sketch has `REGISTERS`
registers: register i is the largest of floor(1 - log_b(x_i)) over the shingles,
x_i an exponential variate that the i-th hash draws for the shingle; so it is a
truncated, exponentially spaced minimum. Sketches of two sets merge by maximum,
and with b near 1 two registers agree with about the probability of the Jaccard
similarity. Documents that agree in all registers of a band are candidates.

Identical sets are one class, so copies cost nothing in the search. The classes
of a bucket first propose only the bucket's smallest class; of these pairs, the
likelihood of (larger, equal, smaller) registers, jointly with the set sizes,
estimates the similarity; per class the most similar proposal is verified on the
full sets and the links are contracted to components. What remains is checked in
full: every pair of a bucket that lies in two components, is likely enough and
was not verified yet. So no link between different texts is left out of the
candidates, while a group of n near copies gives n pairs and not n * n.

Shingles are 64-bit hashes of `width` consecutive words (white space separates,
A-Z in lower case); a shorter text is one shingle. Defined results: null texts
and texts without words have no shingles and stand alone; a null id stays null
and takes part with its text; rows that repeat an id are compared by their own
texts; an empty table gives an empty table. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinia.llm.components import components
from affinia.llm.words import LOWER, WHITE, Words, mix, pieces, utf8, words_of
from affinia.session import materialise

WIDTH = 5
THRESHOLD = 0.8
# 36 bands of 7 registers find a pair at similarity 0.8 with probability 0.9998.
BANDS, ROWS = 36, 7
REGISTERS = BANDS * ROWS
BASE, RATE, LIMIT = 1.001, 20.0, (1 << 16) - 2
# Standard deviations of the estimate that a pair may lie under the threshold and still be verified.
MARGIN = 4.0

_random = np.random.default_rng(20240229)
_FLIP = _random.integers(0, 1 << 64, REGISTERS, np.uint64, endpoint=False)
_SPREAD = _random.integers(0, 1 << 64, REGISTERS, np.uint64, endpoint=False) | np.uint64(1)
_STRIDE = 1 << 15


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text in a row, and the n + 1 borders between the texts."""
    at, got = words.rolling(width)
    cuts = np.searchsorted(words.doc[at], np.arange(len(words.first)))
    sets = []
    for d in range(len(words.first) - 1):
        a, b = cuts[d], cuts[d + 1]
        if b > a:
            sets.append(np.unique(got[a:b]))
            continue
        own = words.hash[words.first[d] : words.first[d + 1]]
        total = np.full(1 if len(own) else 0, len(own), np.uint64)
        for h in own:
            total = mix(total ^ h)
        sets.append(total)
    borders = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), borders


def registers(flat: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """SetSketch registers [text, register] of the sets; an empty set has zeros."""
    n = len(borders) - 1
    least = np.full((REGISTERS, n), np.iinfo(np.uint64).max, np.uint64)
    full = np.flatnonzero(np.diff(borders))
    # a stretch of sets at a time, so that the numbers stay in the cache
    at = 0
    while at < len(full):
        upto = max(at + 1, int(np.searchsorted(borders[full], borders[full[at]] + _STRIDE)))
        some = full[at:upto]
        x = flat[borders[some[0]] : borders[some[-1] + 1]]
        starts = borders[some] - borders[some[0]]
        for i in range(REGISTERS):
            least[i, some] = np.minimum.reduceat((x ^ _FLIP[i]) * _SPREAD[i], starts)
        at = upto
    uniform = (least.astype(np.float64) + 0.5) / 2.0**64
    with np.errstate(divide="ignore"):
        variate = -np.log1p(-np.minimum(uniform, 1 - 2.0**-53)) / RATE
        value = np.floor(1 - np.log(variate) / np.log(BASE))
    value = np.clip(value, 0, LIMIT + 1).astype(np.uint16)
    value[:, np.diff(borders) == 0] = 0
    return np.ascontiguousarray(value.T)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def band_keys(value: np.ndarray) -> np.ndarray:
    """One 64-bit key for each text and band."""
    out = np.empty((len(value), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(value), band + 1, np.uint64)
        for i in range(band * ROWS, (band + 1) * ROWS):
            key = mix(key ^ value[:, i].astype(np.uint64))
        out[:, band] = key
    return out


def estimate(larger: np.ndarray, equal: np.ndarray, smaller: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from register comparisons and the sizes of both sets."""
    u, v = size_a / (size_a + size_b), size_b / (size_a + size_b)
    top = np.minimum(u / v, v / u)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        up, down = p(u - v * j), p(v - u * j)
        tiny = 1e-12
        return larger * np.log(up + tiny) + smaller * np.log(down + tiny) + equal * np.log(np.maximum(1 - up - down, 0) + tiny)

    low, high, golden = np.zeros_like(top), top, (np.sqrt(5) - 1) / 2
    for _ in range(24):  # the likelihood is concave: golden section
        c, d = high - golden * (high - low), low + golden * (high - low)
        left = likelihood(c) > likelihood(d)
        low, high = np.where(left, low, c), np.where(left, d, high)
    return (low + high) / 2


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_row"), F.col(text_col).alias("_text"))


def sketches(rows: DataFrame, width: int) -> DataFrame:
    """(_id, _row, n_shingles, node, regs): `node` names the set, null for an empty one."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            data, borders = utf8(batch.column("_text"))
            flat, cuts = shingles(words_of(LOWER[data], borders, WHITE), width)
            value = registers(flat, cuts)
            size = np.diff(cuts)
            node = [
                int.from_bytes(hashlib.blake2b(flat[a:b].tobytes(), digest_size=8).digest(), "little", signed=True) if b > a else None
                for a, b in zip(cuts[:-1], cuts[1:])
            ]
            regs = [r.tobytes() if n else None for r, n in zip(value, size)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_row"), pa.array(size, pa.int64()), pa.array(node, pa.int64()), pa.array(regs, pa.binary())],
                ["_id", "_row", "n_shingles", "node", "regs"],
            )

    ddl = "n_shingles bigint, node bigint, regs binary"
    return rows.mapInArrow(scan, T.StructType([rows.schema["_id"], rows.schema["_row"], *T.StructType.fromDDL(ddl).fields]))


def _banded(sketch: DataFrame) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = np.frombuffer(b"".join(batch.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)
            keys = band_keys(value).view(np.int64)
            node = np.repeat(batch.column("node").to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(node)], ["key", "node"])

    return sketch.where("node is not null").select("node", "regs").mapInArrow(scan, "key bigint, node bigint")


@F.arrow_udf(T.DoubleType())
def likely_similarity(regs_a: pa.Array, regs_b: pa.Array, size_a: pa.Array, size_b: pa.Array) -> pa.Array:
    a, b = (np.frombuffer(b"".join(x.to_pylist()), np.uint16).reshape(-1, REGISTERS) for x in (regs_a, regs_b))
    larger, smaller = (a > b).sum(axis=1), (a < b).sum(axis=1)
    sizes = (x.to_numpy().astype(np.float64) for x in (size_a, size_b))
    return pa.array(estimate(larger, REGISTERS - larger - smaller, smaller, *sizes))


def likely_pairs(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs whose sketches and sizes allow the threshold."""
    side = {s: classes.select(F.col("node").alias(s), F.col("regs").alias(f"regs_{s}"), F.col("n_shingles").alias(f"n_{s}")) for s in "ab"}
    met = pairs.join(side["a"], "a").join(side["b"], "b")
    met = met.where(F.least("n_a", "n_b") >= F.lit(threshold - 1e-9) * F.greatest("n_a", "n_b"))
    cutoff = threshold - MARGIN * (threshold * (1 - threshold) / REGISTERS) ** 0.5
    return (
        met.select("a", "b", likely_similarity("regs_a", "regs_b", "n_a", "n_b").alias("similarity"))
        .where(F.col("similarity") >= cutoff)
    )


def full_sets(rows: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of the wanted (_id, _row, node) rows, from their whole texts."""
    w = wanted.select(F.col("_id").alias("_wid"), F.col("_row").alias("_wrow"), "node")
    texts = rows.where(F.col("_text").isNotNull()).join(
        w, F.col("_id").eqNullSafe(F.col("_wid")) & (F.col("_row") == F.col("_wrow"))
    ).select("node", "_text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            data, borders = utf8(batch.column("_text"))
            flat, cuts = shingles(words_of(LOWER[data], borders, WHITE), width)
            packed = [flat[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(packed, pa.binary())], ["node", "shingles"])

    return texts.mapInArrow(scan, "node bigint, shingles binary").dropDuplicates(["node"])


@F.arrow_udf(T.LongType())
def common(a: pa.Array, b: pa.Array) -> pa.Array:
    """Number of hashes in both sorted sets."""
    out = []
    for x, y in zip(a, b):
        both = np.concatenate([np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)])
        both.sort(kind="stable")
        out.append(int((both[1:] == both[:-1]).sum()))
    return pa.array(out, pa.int64())


def linked(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    met = pairs.select("a", "b").join(a, "a").join(b, "b")
    both = met.select(
        "a", "b", common("set_a", "set_b").alias("n"),
        ((F.octet_length("set_a") + F.octet_length("set_b")) / 8).cast("bigint").alias("total"),
    )
    # whole numbers: 100 * intersection >= 80 * union
    return both.where(100 * F.col("n") >= F.lit(round(100 * threshold)) * (F.col("total") - F.col("n"))).select("a", "b")


# Members of a bucket that one task compares with each other or with as many others.
SLICE = 2048
UNIT = ["key", "lo", "hi"]


def _tasks(df: DataFrame) -> int:
    """Few bytes take long to compare here, so units are not put together by their size."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One batch per (key, lo, hi) of sorted rows."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        unit = np.stack([batch.column(c).to_numpy() for c in UNIT])
        cuts = [0, *(np.flatnonzero((unit[:, 1:] != unit[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            now = tuple(unit[:, a].tolist())
            if held and now != last:
                yield pa.concat_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.concat_batches(held)


def _likely(unit: pa.RecordBatch, cutoff: float, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """(row, other rows) of a unit that lie in two components and are likely enough.

    A pair that shares several bands is looked at in the first of them only.
    """
    regs = np.frombuffer(b"".join(unit.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)
    keys = band_keys(regs).view(np.int64)
    band = int(np.argmax(keys[0] == unit.column("key")[0].as_py()))
    comp, part, size = (unit.column(c).to_numpy() for c in ("comp", "part", "n_shingles"))
    lo, hi = unit.column("lo")[0].as_py(), unit.column("hi")[0].as_py()
    for i in range(len(regs)):
        j = np.arange(i + 1, len(regs))
        ok = comp[j] != comp[i]
        if lo != hi:
            ok &= part[j] != part[i]
        ok &= np.minimum(size[j], size[i]) >= (threshold - 1e-9) * np.maximum(size[j], size[i])
        j = j[ok]
        if band and len(j):
            j = j[~(keys[j, :band] == keys[i, :band]).any(axis=1)]
        if len(j):
            larger, smaller = (regs[i] > regs[j]).sum(axis=1), (regs[i] < regs[j]).sum(axis=1)
            n = np.full(len(j), size[i], np.float64)
            found = estimate(larger, REGISTERS - larger - smaller, smaller, n, size[j].astype(np.float64))
            j = j[found >= cutoff]
            if len(j):
                yield i, j


def open_members(members: DataFrame, roots: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The bucket members that have a likely partner in another component, by unit of work."""
    labelled = members.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("comp"))
    labelled = materialise(labelled, "labelled")
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("n")).where("x < y")
    parts = F.ceil(F.col("n") / SLICE).cast("int")
    units = (
        labelled.join(mixed.select("key", parts.alias("parts")), "key")
        .withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("key", "node", "comp", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))
        .join(classes.select("node", "regs", "n_shingles"), "node")
        .repartition(_tasks(members), *UNIT).sortWithinPartitions(*UNIT, "node")
    )
    cutoff = threshold - MARGIN * (threshold * (1 - threshold) / REGISTERS) ** 0.5
    names = ["key", "lo", "hi", "part", "node", "comp"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _units(batches):
            open_ = np.zeros(unit.num_rows, bool)
            for i, j in _likely(unit, cutoff, threshold):
                open_[i] = open_[j] = True
            if open_.any():
                yield unit.select(names).filter(pa.array(open_))

    return units.mapInArrow(scan, "key bigint, lo int, hi int, part int, node bigint, comp bigint")


def open_links(opened: DataFrame, classes: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b) links between components, confirmed on the full sets: enough of them to connect what is linked."""
    cutoff = threshold - MARGIN * (threshold * (1 - threshold) / REGISTERS) ** 0.5
    percent = round(100 * threshold)
    units = (
        opened.join(classes.select("node", "regs", "n_shingles"), "node").join(sets, "node")
        .repartition(_tasks(opened), *UNIT).sortWithinPartitions(*UNIT, "node")
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _units(batches):
            own = [np.frombuffer(x, np.uint64) for x in unit.column("shingles").to_pylist()]
            node, comp = unit.column("node").to_numpy(), unit.column("comp").to_numpy()
            label = np.unique(comp, return_inverse=True)[1]
            a, b = [], []
            for i, j in _likely(unit, cutoff, threshold):
                j = j[label[j] != label[i]]
                while len(j):
                    some, j = j[:256], j[256:]
                    size = np.array([len(own[k]) for k in some])
                    flat = np.concatenate([own[k] for k in some])
                    near = np.minimum(np.searchsorted(own[i], flat), len(own[i]) - 1)
                    both = np.add.reduceat((own[i][near] == flat).astype(np.int64), np.cumsum(size) - size)
                    for k in some[100 * both >= percent * (size + len(own[i]) - both)]:
                        if label[k] != label[i]:
                            a.append(node[i])
                            b.append(node[k])
                            label[label == label[k]] = label[i]
                    j = j[label[j] != label[i]]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return units.mapInArrow(scan, "a bigint, b bigint")


def similar_classes(rows: DataFrame, sketch: DataFrame, width: int, threshold: float) -> DataFrame:
    """(node, root) of every class that is linked to another class."""
    banded = _banded(sketch)
    lowest = banded.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most")
    members = materialise(banded.join(lowest, "key").select("key", "node", "least").distinct(), "buckets")
    nodes = members.select("node").distinct()
    classes = materialise(
        sketch.join(nodes, "node").groupBy("node").agg(
            F.min(F.struct("_id", "_row")).alias("who"), F.any_value("regs").alias("regs"),
            F.any_value("n_shingles").alias("n_shingles"),
        ),
        "classes",
    )
    star = members.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    best = likely_pairs(star, classes, threshold).groupBy("b").agg(F.max(F.struct("similarity", "a")).alias("best"))
    best = materialise(best.select("best.a", "b"), "proposals")
    sets = materialise(full_sets(rows, classes.select("who.*", "node"), width), "sets")
    first = materialise(linked(best, sets, threshold), "links")
    opened = materialise(open_members(members, components(first), classes, threshold), "open")
    second = open_links(opened, classes, sets, threshold)
    return components(first.unionAll(second))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: float = THRESHOLD
) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row: `kept` marks the smallest id of each component."""
    rows = _rows(docs, id_col, text_col)
    sketch = materialise(sketches(rows, width), "sketches")
    roots = similar_classes(rows, sketch, width, threshold)
    named = sketch.where("node is not null").groupBy("node").agg(F.min("_id").alias("least"))
    grouped = named.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("group"))
    smallest = grouped.groupBy("group").agg(F.min("least").alias("component_id"))
    of_node = materialise(grouped.join(smallest, "group").select("node", "component_id"), "groups")
    component: Column = F.when(F.col("node").isNull(), F.col("_id")).otherwise(F.col("component_id"))
    return sketch.select("_id", "n_shingles", "node").join(of_node, "node", "left").select(
        F.col("_id").alias(id_col), "n_shingles", component.alias("component_id"),
        F.col("_id").eqNullSafe(component).alias("kept"),
    )
