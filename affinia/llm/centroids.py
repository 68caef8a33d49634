"""Centroid clustering (Lloyd's rounds) over zone maps of vectors in Hilbert order.

Vectors become integers, so every distance, sum and mean is exact and the result
does not depend on the order of the rows. They are written once, sorted along a
Hilbert curve over their leading principal axes and cut into zones of `ZONE`
vectors. A zone carries the box of its vectors (least and largest value of each
component), their number and their sum.

For a zone, d(x, p) - d(x, j) of two centroids is linear in x, so its largest
value over the box is exact. Every centroid j that is nowhere in the box nearer
than the centroid p next to the box's middle is no candidate. A zone with one
candidate adds its stored sum and is not unpacked; in all others the vectors are
compared with the candidates only. On data without clusters no centroid can be
ruled out and all are compared.

A round sends the centroids to the executors and gets one row per component of a
centroid back, summed in Spark. The curve only orders: range partitions are cut
by key and row number, so equal vectors may fill many partitions.

Defined results: vectors that are null, not of `dim` components, or hold a null
or non-finite component are left out; rows that repeat an id or a vector each
count; a null id is never drawn as a start unless ids run out; ties go to the
smaller number; with fewer vectors than centroids every vector is a start; an
empty table, or one without usable vectors, gives an empty table. Integers beyond
+-2**27 count as that bound, as their squared distances exceed 64 bits; inertia
that exceeds 64 bits is null. Only the two named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinia.session import materialise

DIM = 64
SCALE = 64.0
ZONE = 128
AXES, BITS = 8, 7  # of the curve: a key of 56 bits
LARGEST = 1 << 27
EXACT = 1 << 21  # up to here sums of DIM squares are exact in doubles
RESULT = "cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of grid cells [row, axis], by Skilling's transform."""
    x = [column.astype(np.int64) for column in cells.T]
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(len(x)):
            inverted = (x[i] & q) != 0
            swap = np.where(inverted, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(inverted, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros(len(cells), np.int64)
    q = top
    while q > 1:
        flip ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    key = np.zeros(len(cells), np.int64)
    for bit in range(bits - 1, -1, -1):
        for column in x:
            key = (key << 1) | (((column ^ flip) >> bit) & 1)
    return key


def pack(v: np.ndarray) -> bytes:
    """Integers in the narrowest type that holds them; the length of the bytes tells which."""
    least, most = (int(v.min()), int(v.max())) if v.size else (0, 0)
    for kind in (np.int8, np.int16):
        if np.iinfo(kind).min <= least and most <= np.iinfo(kind).max:
            return v.astype(kind).tobytes()
    return v.astype(np.int32).tobytes()


def unpack(raw: bytes, rows: int, dim: int) -> np.ndarray:
    kind = {1: np.int8, 2: np.int16, 4: np.int32}[len(raw) // (rows * dim)]
    return np.frombuffer(raw, kind).reshape(rows, dim).astype(np.int64)


def integers(column: pa.Array, dim: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the usable rows of a list column, and floor(scale * component) of each [row, component]."""
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(size == dim)
    flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    usable = np.isfinite(flat).all(axis=1)  # a null is NaN here
    with np.errstate(over="ignore"):
        whole = np.clip(np.floor(scale * flat[usable]), -LARGEST, LARGEST)
    return rows[usable], whole.astype(np.int64)


def candidates(lo: np.ndarray, hi: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that can be nearest to some point of the box, in order."""
    middle = (lo + hi) / 2
    pivot = int(((centroids - middle) ** 2).sum(axis=1).argmin())
    away = centroids - centroids[pivot]
    squares = (centroids * centroids).sum(axis=1)
    # the largest d(x, pivot) - d(x, j) over the box
    gain = 2 * np.where(away > 0, away * hi, away * lo).sum(axis=1) + squares[pivot] - squares
    number = np.arange(len(centroids))
    return number[(gain > 0) | ((gain == 0) & (number <= pivot))]


def nearest(v: np.ndarray, centroids: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid and squared distance of each vector, exactly; the smaller number wins a tie."""
    some = centroids[among]
    if max(np.abs(v).max(initial=0), np.abs(some).max(initial=0)) <= EXACT:
        products = (v.astype(np.float64) @ some.T.astype(np.float64)).astype(np.int64)
    else:
        products = v @ some.T
    distance = (v * v).sum(axis=1)[:, None] - 2 * products + (some * some).sum(axis=1)
    best = distance.argmin(axis=1)
    return among[best], distance[np.arange(len(v)), best]


def _usable(vectors: DataFrame, dim: int, scale: float) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, whole = integers(batch.column("_vec"), dim, scale)
            packed = pa.array([pack(v) for v in whole], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("_id").take(pa.array(rows)), packed], ["_id", "vec"])

    return vectors.mapInArrow(scan, T.StructType([vectors.schema["_id"], T.StructField("vec", T.BinaryType())]))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    rows = [unpack(raw, 1, dim) for raw in column.to_pylist()]
    return np.concatenate(rows) if rows else np.zeros((0, dim), np.int64)


def principal_axes(vectors: DataFrame, dim: int, axes: int = AXES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, the leading axes [component, axis], and the deviation along each."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((dim + 1, dim + 1))
        for batch in batches:
            v = _matrix(batch.column("vec"), dim).astype(np.float64)
            v = np.hstack([v, np.ones((len(v), 1))])
            sums += v.T @ v
        at = np.arange(sums.size, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums.ravel())], ["at", "total"])

    found = vectors.select("vec").mapInArrow(scan, "at int, total double").groupBy("at").agg(F.sum("total").alias("total"))
    sums = np.zeros((dim + 1) ** 2)
    for row in found.collect():  # (dim + 1) squared numbers
        sums[row["at"]] = row["total"]
    sums = sums.reshape(dim + 1, dim + 1)
    n = max(sums[-1, -1], 1.0)
    mean = sums[-1, :-1] / n
    spread, directions = np.linalg.eigh(sums[:-1, :-1] / n - np.outer(mean, mean))
    order = np.argsort(-spread, kind="stable")[:axes]
    return mean, directions[:, order], np.sqrt(np.maximum(spread[order], 1e-12))


def zones(vectors: DataFrame, dim: int, size: int = ZONE) -> DataFrame:
    """A row per zone of vectors that follow each other on the curve: ids, packed vectors, box and sum."""
    mean, axes, deviation = principal_axes(vectors, dim)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            along = (_matrix(batch.column("vec"), dim) - mean) @ axes / deviation  # three deviations to both sides
            cells = np.clip((along + 3) / 6 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
            key = hilbert(cells, BITS) if len(cells) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key)], [*batch.schema.names, "key"])

    numbered = vectors.withColumn("row", F.monotonically_increasing_id())  # of a written table: the same at every attempt
    placed = numbered.mapInArrow(place, T.StructType([*numbered.schema.fields, T.StructField("key", T.LongType())]))
    ordered = placed.repartitionByRange("key", "row").sortWithinPartitions("key", "row").select("_id", "vec")
    id_type = vectors.schema["_id"].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 64 * size:
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                full = rows // size * size
                yield zone_rows(whole.slice(0, full))
                held, rows = [whole.slice(full)], rows - full
        if rows:
            yield zone_rows(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    def zone_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        v = _matrix(batch.column("vec"), dim)
        starts = np.arange(0, len(v), size)
        ends = np.minimum(starts + size, len(v))
        ids = batch.column("_id")
        boxes = [(v[a:b], pack(v[a:b])) for a, b in zip(starts, ends)]
        return pa.RecordBatch.from_arrays(
            [
                pa.ListArray.from_arrays(pa.array(np.append(starts, len(v)), pa.int32()), ids),
                pa.array([raw for _, raw in boxes], pa.binary()),
                *(pa.array([f(part).astype(np.int64).tobytes() for part, _ in boxes], pa.binary()) for f in (_least, _most, _sum)),
            ],
            ["ids", "vecs", "lo", "hi", "total"],
        )

    fields = [T.StructField("ids", T.ArrayType(id_type)), *(T.StructField(c, T.BinaryType()) for c in ("vecs", "lo", "hi", "total"))]
    return ordered.mapInArrow(cut, T.StructType(fields))


def _least(part: np.ndarray) -> np.ndarray:
    return part.min(axis=0)


def _most(part: np.ndarray) -> np.ndarray:
    return part.max(axis=0)


def _sum(part: np.ndarray) -> np.ndarray:
    return part.sum(axis=0)


def _long(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64)


def next_centroids(found: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: floor of the mean of every centroid's vectors; those without vectors stay."""
    k, dim = centroids.shape

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, dim + 1), np.int64)  # the last one counts
        for batch in batches:
            for size, raw, lo, hi, total in zip(
                batch.column("ids").value_lengths().to_pylist(), *(batch.column(c).to_pylist() for c in ("vecs", "lo", "hi", "total"))
            ):
                among = candidates(_long(lo), _long(hi), centroids)
                if len(among) == 1:
                    sums[among[0], :dim] += _long(total)
                    sums[among[0], dim] += size
                    continue
                v = unpack(raw, size, dim)
                number, _ = nearest(v, centroids, among)
                order = np.argsort(number, kind="stable")
                own, first, count = np.unique(number[order], return_index=True, return_counts=True)
                sums[own, :dim] += np.add.reduceat(v[order], first, axis=0)
                sums[own, dim] += count
        used = np.flatnonzero(sums[:, dim])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(used, dim + 1).astype(np.int32)), pa.array(np.tile(np.arange(dim + 1, dtype=np.int32), len(used))),
                pa.array(sums[used].ravel()),
            ],
            ["cluster", "at", "total"],
        )

    partial = found.mapInArrow(scan, "cluster int, at int, total bigint")
    totals = partial.groupBy("cluster", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    sums = {(r["cluster"], r["at"]): int(r["total"]) for r in totals.collect()}  # k * (dim + 1) numbers
    out = centroids.copy()
    for c in {c for c, _ in sums}:
        out[c] = [sums[c, i] // sums[c, dim] for i in range(dim)]
    return out


def assigned(found: DataFrame, centroids: np.ndarray, id_field: T.StructField) -> DataFrame:
    """(_id, cluster, distance) of every vector of the zones."""
    dim = centroids.shape[1]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("ids").value_lengths().to_pylist()
            got = [
                nearest(unpack(raw, n, dim), centroids, candidates(_long(lo), _long(hi), centroids))
                for n, raw, lo, hi in zip(size, *(batch.column(c).to_pylist() for c in ("vecs", "lo", "hi")))
            ]
            if got:
                number, distance = (np.concatenate(part) for part in zip(*got))
                columns = [batch.column("ids").flatten(), pa.array(number, pa.int32()), pa.array(distance, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["_id", "cluster", "distance"])

    fields = T.StructType([id_field, *T.StructType.fromDDL("cluster int, distance bigint").fields])
    return found.select("ids", "vecs", "lo", "hi").mapInArrow(scan, fields)


def starts(vectors: DataFrame, k: int, dim: int, seed: str) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of seed, colon and id."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_id").cast("string")).cast("binary"), 256)
    first = vectors.select(drawn.alias("h"), "vec").orderBy(F.col("h").asc_nulls_last(), "vec").limit(k).collect()
    return np.concatenate([unpack(bytes(r["vec"]), 1, dim) for r in first]) if first else np.zeros((0, dim), np.int64)


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def cluster(
    vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = DIM, scale: float = SCALE, seed: str = "1",
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector, and the centroids."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).cast("array<double>").alias("_vec"))
    usable = materialise(_usable(rows, dim, scale), "vectors")
    centroids = starts(usable, k, dim, seed)
    if not len(centroids):
        fields = T.StructType([T.StructField(id_col, rows.schema["_id"].dataType), *T.StructType.fromDDL(RESULT).fields])
        return spark.createDataFrame([], fields), centroids
    found = materialise(zones(usable, dim), "zones")
    for _ in range(rounds):
        centroids = next_centroids(found, centroids)
    own = materialise(assigned(found, centroids, rows.schema["_id"]), "assigned")
    inertia = {
        r["cluster"]: int(r["total"])
        for r in own.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()  # k rows
    }
    whole = sum(inertia.values())
    longs = [x if x < 1 << 63 else None for x in (whole, *(inertia.get(c, 0) for c in range(len(centroids))))]
    about = spark.createDataFrame(
        [(c, longs[c + 1], longs[0], digest(v)) for c, v in enumerate(centroids)],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
    )
    joined = own.join(F.broadcast(about), "cluster")  # k rows
    return joined.select(F.col("_id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centroids
