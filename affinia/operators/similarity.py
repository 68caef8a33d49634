"""Set similarity by MinHash bands and by prefix join; vector similarity."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinia.functions.scalars import hash32, rounded
from affinia.functions.vectors import dot, is_zero, l2_normalize
from affinia.operators.scale import bucketed_row_number, dense_index, slices
from affinia.session import materialise

# Hashes of the plain signature, and the least similarity that the similarity job keeps.
NUM_HASHES, THRESHOLD = 50, 0.5
MODULUS = 2_147_483_647  # prime above every 31-bit index
SECOND_MODULUS = 2_147_483_629  # the prime below
# Registers of a sketch, unless the threshold needs more.
REGISTERS = 512
# Share of the pairs at the threshold that share a band, and that also have enough equal registers.
BAND_RECALL, AGREEMENT_RECALL = 0.96, 0.995
RECALL = 0.95  # of both, with room
# Sets that a list of a user's sets holds on average, at most.
MEMBERS = 1024
DEVIATIONS = NormalDist().inv_cdf(AGREEMENT_RECALL)


# --- sets of users ---------------------------------------------------------


def user_sets(pairs: DataFrame, users: DataFrame) -> DataFrame:
    """Distinct (business_id, user_idx) edges; a business's rows are its user set."""
    return (
        pairs.select("business_id", "user_id").distinct()
        .join(users.select("user_id", F.col("idx").alias("user_idx")), "user_id")
        .select("business_id", "user_idx")
    )


def set_groups(edges: DataFrame) -> DataFrame:
    """(business_id, size, representative): businesses with the same user set share
    the smallest id as representative.

    Sets are compared by size and two 64-bit fingerprints. Only representatives
    meet in bands, so a large group of copies is linked with one row per member
    and never paired with itself.
    """
    prints = edges.groupBy("business_id").agg(
        F.count("*").alias("size"),
        F.bit_xor(F.xxhash64("user_idx")).alias("f1"),
        F.bit_xor(F.xxhash64("user_idx", F.lit("second"))).alias("f2"),
    )
    firsts = prints.groupBy("size", "f1", "f2").agg(F.min("business_id").alias("representative"))
    return prints.join(firsts, ["size", "f1", "f2"]).select("business_id", "size", "representative")


def hash_params(n: int = NUM_HASHES, seed: int | str = 42) -> list[tuple[int, int]]:
    """(a, b) of each hash (a x + b) mod MODULUS, drawn independently by seed."""
    draw = random.Random(seed)
    return [(draw.randrange(1, MODULUS), draw.randrange(MODULUS)) for _ in range(n)]


@dataclass(frozen=True)
class Layout:
    """Bands of a sketch: `bands` times `rows` of its `registers`."""

    threshold: float
    rows: int
    bands: int
    registers: int

    @classmethod
    def solve(cls, threshold: float, registers: int = REGISTERS, recall: float = BAND_RECALL) -> Layout:
        """Most rows per band with which a pair at the threshold shares a band with probability `recall`.

        More rows let fewer dissimilar pairs through and need more bands. Where even bands of one row
        need more registers than given, there are as many as they need.
        """
        rows, bands = 1, cls._bands(threshold, 1, recall)
        while (rows + 1) * cls._bands(threshold, rows + 1, recall) <= registers:
            rows, bands = rows + 1, cls._bands(threshold, rows + 1, recall)
        return cls(threshold, rows, bands, max(registers, rows * bands))

    @staticmethod
    def _bands(threshold: float, rows: int, recall: float) -> int:
        if threshold >= 1.0:
            return 1
        return max(1, math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows))))

    def least_agreement(self, n1: Column, n2: Column) -> Column:
        """Equal registers that a pair of sets at the threshold reaches with probability `AGREEMENT_RECALL`.

        Registers are drawn from the union of both sets, so a small union gives fewer independent ones.
        A register is one byte, and bytes are equal by chance once in 256.
        """
        t, k = self.threshold, float(self.registers)
        union = (n1 + n2) / F.lit(1.0 + t)
        independent = F.lit(k) * union / (F.lit(k) + union)
        least = F.lit(t) - F.lit(DEVIATIONS * math.sqrt(t * (1 - t))) / F.sqrt(independent)
        return F.lit(k) * (least * F.lit(255.0) + F.lit(1.0)) / F.lit(256.0)


def sketch_params(seed: int = 42) -> tuple[int, ...]:
    """Factors and shifts of the hash of a member."""
    draw = random.Random(f"sketch-{seed}")
    return tuple(draw.randrange(1, SECOND_MODULUS) for _ in range(4))


def fill_params(registers: int, seed: int = 42) -> list[tuple[int, int]]:
    """(a, b) of each register: (a x + b) mod MODULUS orders the filled registers x that it may take its value from."""
    return hash_params(registers, f"fill-{seed}")


def _fill(number: np.ndarray, value: np.ndarray, factor: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """All registers from the values of the filled ones.

    An empty register takes the value of the filled one that comes first in an order of its own, so two
    sets choose the same one as often as they are similar, and independently in every register.
    """
    out = np.full(len(factor), -1, np.int64)
    out[number] = value
    empty = np.flatnonzero(out < 0)
    if len(empty):
        order = (factor[empty, None] * number + shift[empty, None]) % MODULUS
        out[empty] = value[order.argmin(axis=1)]
    return out


def register_sketch(edges: DataFrame, registers: int = REGISTERS, seed: int = 42) -> DataFrame:
    """(business_id, registers, bytes): MinHash registers from one hash per member.

    The hash of a member names its register and its value, and a register keeps its smallest value: one
    aggregation with a row per register, however many members a set has. Empty registers are filled from
    the others. `bytes` holds the low byte of each register.
    """
    a, b, c, d = sketch_params(seed)
    factor, shift = (np.array(x, np.int64) for x in zip(*fill_params(registers, seed)))
    h = ((F.lit(a) * F.col("user_idx") + F.lit(b)) % F.lit(MODULUS) * F.lit(c) + F.lit(d)) % F.lit(SECOND_MODULUS)
    filled = (
        edges.select("business_id", h.alias("h"))
        .groupBy("business_id", (F.col("h") % registers).cast("int").alias("number")).agg(F.min("h").alias("h"))
        .groupBy("business_id").agg(F.collect_list(F.struct("number", F.floor(F.col("h") / registers).cast("int").alias("value"))).alias("found"))
    )

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("found")  # lists of at most `registers`
            size = found.value_lengths().to_numpy(zero_copy_only=False)
            parts = (found.flatten().field(c).to_numpy().astype(np.int64) for c in ("number", "value"))
            rows = [_fill(n, v, factor, shift) for n, v in zip(*(np.split(part, np.cumsum(size)[:-1]) for part in parts))] if len(size) else []
            flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            ends = np.arange(len(rows) + 1, dtype=np.int32) * registers
            low = [(row & 255).astype(np.uint8).tobytes() for row in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("business_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32))), pa.array(low, pa.binary())],
                ["business_id", "registers", "bytes"],
            )

    fields = [edges.schema["business_id"], *T.StructType.fromDDL("registers array<int>, bytes binary").fields]
    return filled.mapInArrow(fill, T.StructType(fields))


def minhash(edges: DataFrame, params: list[tuple[int, int]], modulus: int = MODULUS) -> DataFrame:
    """(business_id, signature): the smallest value of each hash over the set.

    All hashes are plain minimums of one aggregation, so every task sends one
    signature per business and no row is multiplied by the number of hashes.
    """
    x = F.col("user_idx")
    mins = [F.min((F.lit(a) * x + F.lit(b)) % F.lit(modulus)) for a, b in params]
    return edges.groupBy("business_id").agg(F.array(*mins).alias("signature"))


def _size_class(size: Column, threshold: float) -> Column:
    """Sets whose sizes differ by less than 1/threshold differ by one class at most."""
    if threshold >= 1.0:
        return size
    return F.floor(F.log(size) / F.lit(math.log(1.0 / threshold)) + F.lit(1e-9))


def _near_sizes(rows: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Distinct (business_id_1, business_id_2) that meet on `keys` and whose sizes
    leave a Jaccard of `threshold` possible.

    The size class is part of the join key, which cuts a hot key into pieces that
    cannot match each other; the remaining test is in the join condition, so
    hopeless pairs are never emitted.
    """
    small, big = (side.alias(name) for side, name in zip(_size_sides(rows, threshold), ("s", "g")))
    on = _may_match(threshold)
    for key in [*keys, "cls"]:
        on = on & (F.col(f"s.{key}") == F.col(f"g.{key}"))
    return small.join(big, on).select(*_pair_columns()).distinct()


def _size_sides(rows: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join of sets with size class `cls`: the larger set meets its own class and the one below."""
    c = _size_class(F.col("size"), threshold)
    big = rows.withColumn("_c", c).withColumn("cls", F.explode(F.array(F.col("_c"), F.col("_c") - 1) if threshold < 1.0 else F.array("_c")))
    return rows.withColumn("cls", c), big.drop("_c")


def _may_match(threshold: float) -> Column:
    """The smaller set `s` is large enough for `g`; each unordered pair passes once."""
    smaller = (F.col("s.size") < F.col("g.size")) | (
        (F.col("s.size") == F.col("g.size")) & (F.col("s.business_id") < F.col("g.business_id"))
    )
    return smaller & (F.col("s.size") >= F.lit(threshold - 1e-9) * F.col("g.size"))


def _pair_columns() -> list[Column]:
    return [
        F.least("s.business_id", "g.business_id").alias("business_id_1"),
        F.greatest("s.business_id", "g.business_id").alias("business_id_2"),
    ]


def lsh_candidates(sketches: DataFrame, layout: Layout) -> DataFrame:
    """Pairs that share a band and agree in enough registers to reach the threshold.

    `sketches` is (business_id, size, registers, bytes). Only the band keys meet in the join; the bytes of
    both sides are compared before any set is read.
    """
    keys = F.transform(
        F.sequence(F.lit(0), F.lit(layout.bands - 1)),
        lambda i: F.struct(i.alias("band"), F.xxhash64(F.slice("registers", i * layout.rows + 1, layout.rows)).alias("key")),
    )
    banded = sketches.select("business_id", "size", F.explode(keys).alias("x")).select("business_id", "size", "x.band", "x.key")
    met = _near_sizes(banded, ["band", "key"], layout.threshold)
    for i in (1, 2):
        side = sketches.select(F.col("business_id").alias(f"business_id_{i}"), F.col("size").alias(f"n{i}"), F.col("bytes").alias(f"bytes{i}"))
        met = met.join(side, f"business_id_{i}")
    counted = met.withColumn("agree", _equal_bytes("bytes1", "bytes2"))
    return counted.where(F.col("agree") >= layout.least_agreement(F.col("n1"), F.col("n2"))).select("business_id_1", "business_id_2")


@F.arrow_udf(T.IntegerType())
def _equal_bytes(a: pa.Array, b: pa.Array) -> pa.Array:
    """Places where two byte strings of one length are equal."""
    if not len(a):
        return pa.array([], pa.int32())
    x, y = (np.frombuffer(b"".join(side.to_pylist()), np.uint8).reshape(len(a), -1) for side in (a, b))
    return pa.array((x == y).sum(axis=1).astype(np.int32))


def _common(pairs: DataFrame, edges: DataFrame, n1: str, n2: str) -> DataFrame:
    """Users both businesses of a pair have, as `common`; pairs without any drop out.

    The smaller set of a pair is the one that is listed, so a very popular
    business is only probed.
    """
    first_small = F.col(n1) <= F.col(n2)
    one, two = F.col("business_id_1"), F.col("business_id_2")
    sided = pairs.withColumn("small", F.when(first_small, one).otherwise(two)).withColumn(
        "big", F.when(first_small, two).otherwise(one)
    )
    small = edges.select(F.col("business_id").alias("small"), "user_idx")
    big = edges.select(F.col("business_id").alias("big"), "user_idx")
    return (
        sided.join(small, "small").join(big, ["big", "user_idx"], "left_semi")
        .groupBy(*pairs.columns).agg(F.count("*").alias("common"))
    )


def _with_sizes(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    one = sizes.select(F.col("business_id").alias("business_id_1"), F.col("size").alias("n1"))
    two = sizes.select(F.col("business_id").alias("business_id_2"), F.col("size").alias("n2"))
    return pairs.join(one, "business_id_1").join(two, "business_id_2")


def _above(counted: DataFrame, threshold: float) -> DataFrame:
    value = F.col("common") / (F.col("n1") + F.col("n2") - F.col("common"))
    return counted.select("business_id_1", "business_id_2", value.alias("similarity")).where(
        F.col("similarity") >= threshold
    )


def jaccard(candidates: DataFrame, edges: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Exact Jaccard of candidate pairs, kept from `threshold`; common users are
    counted through two equi-joins."""
    sizes = edges.groupBy("business_id").agg(F.count("*").alias("size"))
    return _above(_common(_with_sizes(candidates, sizes), edges, "n1", "n2"), threshold)


def similar_businesses(edges: DataFrame, threshold: float = THRESHOLD, seed: int = 42) -> DataFrame:
    """Similar pairs by bands of register sketches with exact verification, smaller id first.

    A pair at the threshold is found with probability `RECALL`, whatever the threshold. Businesses with
    equal user sets are linked to their representative with similarity 1; other pairs are between
    representatives.
    """
    edges = materialise(edges, "edges")
    groups = materialise(set_groups(edges), "set-groups")
    reps = groups.where("business_id = representative").select("business_id", "size")
    rep_edges = edges.join(reps, "business_id", "left_semi")
    layout = Layout.solve(threshold)
    sketches = materialise(register_sketch(rep_edges, layout.registers, seed).join(reps, "business_id"), "sketches")
    candidates = materialise(lsh_candidates(sketches, layout), "candidates")
    return jaccard(candidates, rep_edges, threshold).unionByName(_copies(groups))


def _copies(groups: DataFrame) -> DataFrame:
    return groups.where("business_id <> representative").select(
        F.col("representative").alias("business_id_1"), F.col("business_id").alias("business_id_2"),
        F.lit(1.0).alias("similarity"),
    )


def jaccard_all(edges: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Every pair with Jaccard of at least `threshold`, exactly: the yardstick for
    the banded search, in the same representative form.

    The users of every set are ordered from rare to frequent. Two sets at the threshold share a user in
    the first |x| - ceil(t |x|) + 1 of both, so only these prefixes meet, which leaves the most
    active users out of large sets. The users that two prefixes share are counted, and with the places
    behind them they bound the whole overlap from above: only pairs that can still reach the threshold
    are looked up in the full sets. Sets go by number until the end.
    """
    edges = materialise(edges, "edges")
    groups = materialise(set_groups(edges), "set-groups")
    reps = groups.where("business_id = representative").select("business_id", "size")
    numbered = materialise(reps.join(dense_index(reps, "business_id", "number"), "business_id"), "numbered")
    rep_edges = materialise(edges.join(numbered, "business_id").select(F.col("number").alias("business_id"), "size", "user_idx"), "rep-edges")
    placed = materialise(_placed(rep_edges), "placed")
    # a user of one set alone brings no pair
    counted = _prefix_overlap(placed.where((F.col("pos") <= F.col("size") - _behind("size", threshold)) & (F.col("f") > 1)), threshold)
    # users that are not in both prefixes stand behind the end of the prefix that ends first, whichever it is
    rest = F.greatest(
        F.least(_behind("s_size", threshold), F.col("g_size") - F.col("g_at")), F.least(_behind("g_size", threshold), F.col("s_size") - F.col("s_at"))
    )
    needed = F.lit(threshold / (1.0 + threshold)) * (F.col("s_size") + F.col("g_size")) - 1e-9
    pair = [F.least("s", "g").alias("business_id_1"), F.greatest("s", "g").alias("business_id_2")]
    hopeful = materialise(counted.where(F.col("met") + rest >= needed).select(*pair), "hopeful")
    found = jaccard(hopeful, rep_edges.select("business_id", "user_idx"), threshold)
    for i in (1, 2):
        names = numbered.select(F.col("business_id").alias(f"name_{i}"), F.col("number").alias(f"business_id_{i}"))
        found = found.join(names, f"business_id_{i}")
    named = found.select(F.col("name_1").alias("business_id_1"), F.col("name_2").alias("business_id_2"), "similarity")
    return named.unionByName(_copies(groups))


def _behind(size: str, threshold: float) -> Column:
    """Users of a set behind its prefix."""
    return F.ceil(F.lit(threshold) * F.col(size) - F.lit(1e-9)) - 1


def _placed(rep_edges: DataFrame) -> DataFrame:
    """(business_id, size, token, f, pos): users numbered from rare to frequent, their frequency, and their place in each set."""
    frequency = rep_edges.groupBy("user_idx").agg(F.count("*").alias("f"))
    span = rep_edges.agg(F.max("user_idx") + 1).scalar()
    # both grow from rare to frequent, ties by user; only sets larger than a slice are cut within a frequency
    token = F.col("f") * span + F.col("user_idx")
    bucket = F.col("f") * slices(F.col("size")) + F.floor(F.col("user_idx") * slices(F.col("size")) / span)
    numbered = rep_edges.join(frequency, "user_idx").select("business_id", "size", token.alias("token"), "f", bucket.alias("bucket"))
    return bucketed_row_number(numbered, ["business_id"], "bucket", ["token"], "pos").select("business_id", "size", "token", "f", "pos")


def _prefix_overlap(prefix: DataFrame, threshold: float) -> DataFrame:
    """Per pair of sets: the users that both prefixes share, and the last places where they meet.

    The sets of a user are listed in lists of bounded length, and a larger set `g` gets the lists of its
    users: what is shuffled is a row per user of a set with the smaller sets `s` as arrays, not a row per
    pair and user. Pairs are counted where the lists of a set arrive; a very large set is dealt to several
    tasks by the other sets.
    """
    chunks, number = F.floor(F.col("f") / F.lit(MEMBERS)) + 1, F.col("business_id")
    small, big = _size_sides(prefix, threshold)
    lists = small.withColumn("chunk", F.pmod(F.xxhash64(number), chunks)).groupBy("token", "cls", "chunk").agg(
        F.collect_list(F.struct(number.alias("s"), "size", "pos")).alias("members")
    )
    asked = big.select(
        number.alias("g"), F.col("size").alias("g_size"), F.col("pos").alias("g_pos"), "token", "cls",
        F.explode(F.sequence(F.lit(0).cast("bigint"), chunks - 1)).alias("chunk"),
    )
    parts = slices(F.col("g_size"))
    met = asked.join(lists, ["token", "cls", "chunk"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))

    def may_match(m: Column) -> Column:
        smaller = (m.size < F.col("g_size")) | ((m.size == F.col("g_size")) & (m.s < F.col("g")))
        near = m.size >= F.lit(threshold - 1e-9) * F.col("g_size")
        return smaller & near & ((parts == 1) | (F.pmod(F.xxhash64(m.s), parts) == F.col("part")))

    own = F.filter("members", may_match)
    dealt = met.select("g", "part", "g_size", "g_pos", own.alias("m")).select(
        "g", "part", "g_size", "g_pos", *[F.col(f"m.{c}").cast(f"array<{kind}>").alias(c) for c, kind in (("s", "bigint"), ("size", "int"), ("pos", "int"))]
    ).repartition("g", "part")
    entries = dealt.select("g", "part", "g_size", "g_pos", F.explode(F.arrays_zip("s", "size", "pos")).alias("m"))
    return entries.groupBy("g", "part", F.col("m.s").alias("s")).agg(
        F.count("*").alias("met"), F.max("m.pos").alias("s_at"), F.max("g_pos").alias("g_at"),
        F.first("m.size").alias("s_size"), F.first("g_size").alias("g_size"),
    ).drop("part")


# --- vectors ---------------------------------------------------------------


def cosine_matrix(df: DataFrame, key: str, vec: str, n: int = 20, seed: int = 42) -> DataFrame:
    """Cosine of every pair of a seeded sample of n rows: (a, b, similarity).

    The sample is numbered, every row lists the numbers 0 .. n-1, and the partner
    is looked up by its number.
    """
    if n < 1:
        raise ValueError("sample at least one row")
    order = [hash32(F.lit(seed), key), F.col(key)]
    sample = materialise(df.select(key, l2_normalize(vec).alias("v")).orderBy(*order).limit(n), "sample")
    numbered = sample.join(dense_index(sample, key, "_i"), key)
    left = numbered.select(F.col(key).alias("a"), F.col("v").alias("va"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("_i"))
    right = numbered.select("_i", F.col(key).alias("b"), F.col("v").alias("vb"))
    return left.join(right, "_i").select("a", "b", dot("va", "vb").alias("similarity"))


def cosine_by_label(df: DataFrame, label: str, vec: str) -> DataFrame:
    """Mean cosine between the members of two labels, a row never with itself.

    The sum over all pairs of two groups is the dot product of the groups' vector
    sums, so the whole table is read once and no pair is formed.
    """
    sums = (
        df.where(~is_zero(vec))
        .groupBy(label)
        .agg(F.count("*").alias("n"), Summarizer.sum(array_to_vector(l2_normalize(vec))).alias("s"))
        .select(label, "n", F.posexplode(vector_to_array("s")).alias("pos", "x"))
    )
    a = sums.select(F.col(label).alias("label_a"), F.col("n").alias("na"), "pos", F.col("x").alias("xa"))
    b = sums.select(F.col(label).alias("label_b"), F.col("n").alias("nb"), "pos", F.col("x").alias("xb"))
    total = a.join(b, "pos").groupBy("label_a", "label_b", "na", "nb").agg(F.sum(F.col("xa") * F.col("xb")).alias("t"))
    same = F.col("label_a") == F.col("label_b")
    pairs = F.when(same, F.col("na") * (F.col("na") - 1)).otherwise(F.col("na") * F.col("nb"))
    inner = F.when(same, F.col("t") - F.col("na")).otherwise(F.col("t"))
    return total.select("label_a", "label_b", pairs.alias("n_pairs"), (inner / F.nullif(pairs, F.lit(0))).alias("mean_similarity"))


def normalized(df: DataFrame, key: str, vec: str) -> DataFrame:
    """Unit vectors in long form: (key, pos, value)."""
    return df.select(key, F.posexplode(l2_normalize(vec)).alias("pos", "value")).withColumn("value", rounded("value"))
