"""Near-duplicate vectors by counting collisions of one-dimensional projections.

A one-dimensional window wide enough to hold near pairs holds a constant share of
all vectors, so windows alone would be quadratic. Each of `tables` therefore sorts
its projection inside cells: the signs of `bits` further projections, with `bits`
growing with the logarithm of the number of vectors, so a cell stays small. In a
cell the vectors are sorted by the table's projection, and each one collides with
those in the window centred on it. Pairs with at least `MIN_COLLISIONS` collisions
over all tables are verified by their cosine in double precision. The number of
tables is calibrated: a pair exactly at the threshold reaches the count with
probability `RECALL`; more similar pairs do more often.

A pair's count follows from the cell keys and projections that both rows carry,
and the first table in which it collides handles it, so no list of pairs is ever
written: a cell gives each vector its links and one edge to the cell's own
components. Equal vectors are one class with a weight. Cells with more than
`SLICE` classes are cut into slices that meet pairwise in tasks of their own.

Defined results: vectors that are null, empty, all zero or hold a null or
non-finite component link with nothing; vectors of different lengths never link;
a null id stays null and its vector counts like any other; rows that repeat an
id each count; an empty table gives an empty table. Only the two columns are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinia.llm.components import components
from affinia.llm.words import mix
from affinia.session import materialise

THRESHOLD = 0.95
RECALL = 0.995
MIN_COLLISIONS = 2
CELL = 64  # classes that a cell should hold on average
SLICE = 2048
UNIT = ["cell", "lo", "hi"]


@dataclass(frozen=True)
class Plan:
    bits: int
    tables: int
    window: float
    threshold: float


def calibrate(n: int, threshold: float = THRESHOLD, recall: float = RECALL, least: int = MIN_COLLISIONS) -> Plan:
    """Bits by the number of vectors; as many tables as a pair at the threshold needs for the recall."""
    bits = min(60, max(1, math.ceil(math.log2(max(n, 1) / CELL)))) if n > CELL else 1
    spread = math.sqrt(2 - 2 * threshold)  # of the projections' difference at the threshold
    window = 3 * spread
    hit = (1 - math.acos(threshold) / math.pi) ** bits * math.erf(3 / math.sqrt(2))
    tables = least
    while sum(math.comb(tables, c) * hit**c * (1 - hit) ** (tables - c) for c in range(least)) > 1 - recall:
        tables += 1
    return Plan(bits, tables, window, threshold)


def project(unit: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Cell keys [vector, table] and window projections [vector, table] of unit vectors."""
    dim = unit.shape[1]
    random = np.random.default_rng([20240301, dim])
    keys = np.empty((len(unit), plan.tables), np.uint64)
    along = np.empty((len(unit), plan.tables))
    weights = np.uint64(1) << np.arange(plan.bits, dtype=np.uint64)
    for t in range(plan.tables):
        directions = random.standard_normal((dim, plan.bits + 1))
        got = unit @ directions
        signs = ((got[:, :-1] >= 0) * weights).sum(axis=1, dtype=np.uint64)
        keys[:, t] = mix(mix(signs + np.uint64(1)) ^ np.uint64(dim * 100_003 + t))
        along[:, t] = got[:, -1]
    return keys, along


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_id, node, vec): the name and the bytes of each usable vector, as doubles."""
    for batch in batches:
        column = batch.column("_vec")
        names, packed = [], []
        for x in column:
            values = x.values if x.is_valid else None
            v = np.zeros(0) if values is None or values.null_count else values.to_numpy(zero_copy_only=False).astype(np.float64)
            ok = len(v) > 0 and np.isfinite(v).all() and v.any()
            raw = v.tobytes() if ok else None
            names.append(int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True) if ok else None)
            packed.append(raw)
        yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(names, pa.int64()), pa.array(packed, pa.binary())], ["_id", "node", "vec"])


def _unit_rows(packed: pa.Array) -> np.ndarray:
    """Unit vectors of equal length."""
    v = np.frombuffer(b"".join(packed.to_pylist()), np.float64).reshape(len(packed), -1)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # neither squares that overflow nor ones that vanish
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def celled(classes: DataFrame, plan: Plan) -> DataFrame:
    """A row per class and table: (cell, tab, node, weight, vec, keys, along)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = np.array([len(x) for x in batch.column("vec").to_pylist()], np.int64)
            for size in np.unique(length):
                part = batch.filter(pa.array(length == size))
                for at in range(0, part.num_rows, 512):
                    some = part.slice(at, 512)
                    keys, along = project(_unit_rows(some.column("vec")), plan)
                    n = np.repeat(np.arange(some.num_rows), plan.tables)
                    row_keys = pa.array([k.tobytes() for k in keys], pa.binary())
                    row_along = pa.array([a.tobytes() for a in along], pa.binary())
                    take = pa.array(n)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(keys.view(np.int64).ravel()), pa.array(np.tile(np.arange(plan.tables, dtype=np.int32), some.num_rows)),
                            some.column("node").take(take), some.column("weight").take(take), some.column("vec").take(take),
                            row_keys.take(take), row_along.take(take),
                        ],
                        ["cell", "tab", "node", "weight", "vec", "keys", "along"],
                    )

    return classes.select("node", "weight", "vec").mapInArrow(
        scan, "cell bigint, tab int, node bigint, weight bigint, vec binary, keys binary, along binary"
    )


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One batch per (cell, lo, hi) of sorted rows."""
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


def _unit_links(unit: pa.RecordBatch, plan: Plan) -> pa.RecordBatch | None:
    """(node, links, other): links of the unit's own pairs, and a node of the same component."""
    n = unit.num_rows
    tab = unit.column("tab")[0].as_py()
    keys = np.frombuffer(b"".join(unit.column("keys").to_pylist()), np.uint64).reshape(n, -1)
    along = np.frombuffer(b"".join(unit.column("along").to_pylist()), np.float64).reshape(n, -1)
    order = np.argsort(along[:, tab], kind="stable")
    keys, along = keys[order], along[order]
    vectors = _unit_rows(unit.column("vec").take(pa.array(order)))
    node, weight, part = (unit.column(c).to_numpy()[order] for c in ("node", "weight", "part"))
    between = unit.column("lo")[0].as_py() != unit.column("hi")[0].as_py()
    links, label = np.zeros(n, np.int64), np.arange(n)
    ends = np.searchsorted(along[:, tab], along[:, tab] + plan.window, side="right")
    block = max(1, 4_000_000 // (n * plan.tables))
    for a in range(0, n, block):
        b = min(n, a + block)
        upto = int(ends[a:b].max())
        i, j = np.arange(a, b), np.arange(a, upto)
        ok = (j[None, :] > i[:, None]) & (j[None, :] < ends[a:b, None])
        if between:
            ok &= part[a:b, None] != part[None, a:upto]
        x, y = np.nonzero(ok)
        if not len(x):
            continue
        # collisions over all tables: same cell, and inside the window
        met = (keys[x + a] == keys[y + a]) & (np.abs(along[x + a] - along[y + a]) <= plan.window)
        own = (met.argmax(axis=1) == tab) & (met.sum(axis=1) >= MIN_COLLISIONS)
        x, y = x[own] + a, y[own] + a
        near = np.einsum("ij,ij->i", vectors[x], vectors[y]) >= plan.threshold
        x, y = x[near], y[near]
        np.add.at(links, x, weight[y])
        np.add.at(links, y, weight[x])
        while len(x):  # smallest label on both ends until nothing moves
            least = np.minimum(label[x], label[y])
            if (label[x] == least).all() and (label[y] == least).all():
                break
            np.minimum.at(label, label[x], least)
            np.minimum.at(label, label[y], least)
            label = label[label]
    some = np.flatnonzero(links)
    if not len(some):
        return None
    while (label[label] != label).any():
        label = label[label]
    return pa.RecordBatch.from_arrays(
        [pa.array(node[some]), pa.array(links[some]), pa.array(node[label[some]])], ["node", "links", "other"]
    )


def vector_links(classes: DataFrame, plan: Plan) -> DataFrame:
    """(node, links, other) partial results of every cell."""
    rows = celled(classes, plan)
    large = rows.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > SLICE)
    parts = F.coalesce(F.ceil(F.col("n") / SLICE).cast("int"), F.lit(1))
    units = (
        rows.join(large, "cell", "left")
        .withColumn("parts", parts)
        .withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("lo", F.least("part", "other"))
        .withColumn("hi", F.greatest("part", "other"))
        .drop("n", "parts", "other")
        .repartition(*UNIT).sortWithinPartitions(*UNIT)
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _units(batches):
            found = _unit_links(unit, plan)
            if found is not None:
                yield found

    return units.mapInArrow(scan, "node bigint, links bigint, other bigint")


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL
) -> DataFrame:
    """(id, n_links, component_id, kept) of every row: `kept` marks the smallest id of each component."""
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).cast("array<double>").alias("_vec"))
    schema = T.StructType([rows.schema["_id"], *T.StructType.fromDDL("node bigint, vec binary").fields])
    named = materialise(rows.mapInArrow(_classes, schema), "vectors")
    classes = materialise(
        named.where("node is not null").groupBy("node").agg(
            F.min("_id").alias("least"), F.count("*").alias("weight"), F.any_value("vec").alias("vec")
        ),
        "classes",
    )
    plan = calibrate(classes.count(), threshold, recall)
    found = materialise(vector_links(classes, plan), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found, "node", "other")
    grouped = (
        classes.select("node", "least", "weight").join(roots, "node", "left").join(links, "node", "left")
        .select("node", "least", F.coalesce("root", "node").alias("group"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    )
    smallest = grouped.groupBy("group").agg(F.min("least").alias("component_id"))
    of_node = materialise(grouped.join(smallest, "group").select("node", "n_links", "component_id"), "groups")
    component = F.when(F.col("node").isNull(), F.col("_id")).otherwise(F.col("component_id"))
    return named.select("_id", "node").join(of_node, "node", "left").select(
        F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"),
    )
