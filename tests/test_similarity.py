"""Set and vector similarity against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest

from affinia.operators import similarity as L
from affinia.operators import topk as K


def brute(sets, t):
    """Pairs of distinct sets that reach the threshold, copies linked to the first id."""
    first = {}
    for b in sorted(sets):
        first.setdefault(frozenset(sets[b]), b)
    reps = sorted(first.values())
    out = {(first[frozenset(sets[b])], b): 1.0 for b in sets if first[frozenset(sets[b])] != b}
    for a, b in combinations(reps, 2):
        j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        if j >= t - 1e-12:
            out[(a, b)] = j
    return out


def edges(spark, sets):
    return spark.createDataFrame([(b, u) for b, us in sets.items() for u in us], "business_id string, user_idx long")


def random_sets(seed, hot=True):
    rng = random.Random(seed)
    sets = {}
    for i in range(60):
        base = set(rng.sample(range(40), rng.randint(1, 12)))
        if hot and rng.random() < 0.5:
            base |= {900, 901}  # very active users
        sets[f"b{i:02d}"] = base
    for i in range(60, 75):  # copies and near copies
        sets[f"b{i:02d}"] = set(sets[f"b{i - 60:02d}"]) | ({500 + i} if i % 2 else set())
    return sets


def collect(df):
    return {(r.business_id_1, r.business_id_2): r.similarity for r in df.collect()}


def test_fixture_pair(spark):
    found = collect(L.jaccard_all(edges(spark, {"x": {1, 2, 3}, "y": {2, 3, 4}}), 0.5))
    assert found == {("x", "y"): 0.5}


@pytest.mark.parametrize("seed,t", [(1, 0.5), (2, 0.5), (3, 0.3), (4, 1.0), (5, 0.17), (6, 0.8), (9, 0.05)])
def test_jaccard_all(spark, tiny_buckets, seed, t):
    sets = random_sets(seed)
    assert collect(L.jaccard_all(edges(spark, sets), t)) == pytest.approx(brute(sets, t))


@pytest.mark.parametrize("seed,t", [(2, 0.5), (5, 0.17), (9, 0.05)])
def test_jaccard_all_in_short_lists(spark, tiny_buckets, monkeypatch, seed, t):
    """Users with more sets than a list holds, and sets dealt to several tasks."""
    monkeypatch.setattr(L, "MEMBERS", 3)
    sets = random_sets(seed)
    assert collect(L.jaccard_all(edges(spark, sets), t)) == pytest.approx(brute(sets, t))


def test_lists_are_shuffled_instead_of_pairs(spark):
    """A pair of sets is counted where the lists of one of them arrive: no exchange goes by pairs."""
    rows = [(b, 4, u, 5, u + 1) for b in range(5) for u in range(4)]
    plan = L._prefix_overlap(spark.createDataFrame(rows, "business_id long, size long, token long, f long, pos long"), 0.5)
    text = plan._jdf.queryExecution().executedPlan().toString()
    keys = [line for line in text.splitlines() if "Exchange hashpartitioning(" in line]
    assert keys and not any("business_id" in k or "hashpartitioning(s#" in k or ", s#" in k for k in keys)
    assert [r.met for r in plan.collect()] == [4] * 10


def test_only_users_of_all_sets(spark):
    sets = {f"b{i}": {1, 2, 3} | ({10 + i} if i < 3 else set()) for i in range(6)}
    assert collect(L.jaccard_all(edges(spark, sets), 0.6)) == pytest.approx(brute(sets, 0.6))


def test_prefixes_bound_the_overlap(spark):
    """Few pairs that share a user reach the full sets, whose overlap the prefixes bound from above."""
    rng = random.Random(11)
    sets = {f"{i:03d}": set(rng.sample(range(300), 40)) for i in range(60)}
    sets["000"] |= {299}
    sets["000"] -= {min(sets["000"])} if len(sets["000"]) > 40 else set()
    e = edges(spark, sets)
    sizes = e.groupBy("business_id").count().withColumnRenamed("count", "size")
    placed = L._placed(e.join(sizes, "business_id")).collect()
    frequency = {u: sum(u in s for s in sets.values()) for u in range(300)}
    for b, users in sets.items():
        order = sorted(users, key=lambda u: (frequency[u], u))
        rows = sorted((r.pos, r.token) for r in placed if r.business_id == b)
        assert [p for p, _ in rows] == list(range(1, 41))
        assert [t % 300 for _, t in rows] == order and [t for _, t in rows] == sorted(t for _, t in rows)
    seen = []
    keep = L.jaccard
    try:
        L.jaccard = lambda pairs, *rest: seen.append(pairs.count()) or keep(pairs, *rest)
        assert collect(L.jaccard_all(e, 0.3)) == pytest.approx(brute(sets, 0.3))
    finally:
        L.jaccard = keep
    assert seen[0] < 200  # of 1770


def test_banded_search_finds_a_subset_and_most(spark):
    sets = random_sets(7)
    exact = brute(sets, 0.5)
    found = collect(L.similar_businesses(edges(spark, sets), 0.5))
    assert set(found) <= set(exact) and all(found[k] == pytest.approx(exact[k]) for k in found)
    assert len(found) >= 0.9 * len(exact)


THRESHOLDS = (0.02, 0.03, 0.05, 0.1, 0.17, 0.3, 0.5, 0.8, 0.95)


def pairs_at(t, n, rng, size=200):
    """Sets in pairs of a similarity of t or just above."""
    sets = {}
    for i in range(n):
        shared = int(np.ceil(2 * size * t / (1 + t)))
        users = rng.sample(range(10**6), 2 * size - shared)
        sets[f"{i:03d}a"], sets[f"{i:03d}b"] = set(users[:size]), set(users[size - shared :])
    return sets


def sketched(spark, sets, layout, seed=42):
    e = edges(spark, sets)
    sizes = e.groupBy("business_id").count().withColumnRenamed("count", "size")
    return L.register_sketch(e, layout.registers, seed).join(sizes, "business_id")


@pytest.mark.parametrize("t", THRESHOLDS)
def test_bands_follow_the_threshold(t):
    layout = L.Layout.solve(t)
    found = 1 - (1 - t**layout.rows) ** layout.bands
    assert found >= L.BAND_RECALL and found + L.AGREEMENT_RECALL - 1 >= L.RECALL
    assert layout.rows * layout.bands <= layout.registers
    more = L.Layout._bands(t, layout.rows + 1, L.BAND_RECALL) * (layout.rows + 1)
    assert more > L.REGISTERS  # one more row would need more registers


@pytest.mark.parametrize("t, size", [(0.02, 200), (0.05, 60), (0.17, 200), (0.17, 12), (0.5, 40), (0.8, 900)])
def test_recall_at_the_threshold(spark, t, size):
    layout = L.Layout.solve(t)
    sets = pairs_at(t, 250, random.Random(12), size)
    found = {(p.business_id_1, p.business_id_2) for p in L.lsh_candidates(sketched(spark, sets, layout), layout).collect()}
    hits = sum((f"{i:03d}a", f"{i:03d}b") in found for i in range(250))
    assert hits >= 0.95 * 250 - 3 * (250 * 0.95 * 0.05) ** 0.5


def test_few_dissimilar_pairs_are_verified(spark):
    """Sets with a sparse overlap: under a tenth of all pairs reaches the full sets."""
    rng = random.Random(13)
    sets = {f"{i:03d}": set(rng.sample(range(4000), 300)) for i in range(120)}  # similarity about 0.04
    layout = L.Layout.solve(0.17)
    found = L.lsh_candidates(sketched(spark, sets, layout), layout).count()
    assert found < 0.1 * 120 * 119 / 2


def test_sketch_matches_its_definition(spark):
    sets = {"small": {5}, "three": {1, 2, 10**6}, "many": set(range(0, 3000, 7))}
    a, b, c, d = L.sketch_params()
    order = L.fill_params(64)
    for r in L.register_sketch(edges(spark, sets), 64).collect():
        filled = {}
        for u in sets[r.business_id]:
            h = ((a * u + b) % L.MODULUS * c + d) % L.SECOND_MODULUS
            filled[h % 64] = min(filled.get(h % 64, h // 64), h // 64)
        want = [filled[i] if i in filled else filled[min(filled, key=lambda j: (order[i][0] * j + order[i][1]) % L.MODULUS)] for i in range(64)]
        assert r.registers == want and list(r.bytes) == [x & 255 for x in want]


def test_minhash_matches_its_definition(spark):
    sets = random_sets(8)
    params = L.hash_params(10, seed=3)
    got = {r.business_id: r.signature for r in L.minhash(edges(spark, sets), params).collect()}
    assert got == {b: [min((a * u + c) % L.MODULUS for u in us) for a, c in params] for b, us in sets.items()}


def ranked(frame):
    got = {}
    for r in frame.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.item_id, r.score))
    return got


def frames(spark, queries, items):
    i = spark.createDataFrame([(f"i{n:03d}", [float(x) for x in v]) for n, v in enumerate(items)], "i string, v array<double>")
    q = spark.createDataFrame([(f"q{n:03d}", [float(x) for x in v]) for n, v in enumerate(queries)], "q string, v array<double>")
    return q, i


@pytest.mark.parametrize("unit, blocks, pack, k", [(True, 1024, 256, 5), (False, 1024, 4, 5), (False, 3, 256, 100), (True, 2, 7, 1)])
def test_top_k_over_several_blocks(spark, monkeypatch, unit, blocks, pack, k):
    monkeypatch.setattr(K, "MAX_BLOCKS", blocks)
    monkeypatch.setattr(K, "PACK", pack)
    rng = np.random.default_rng(5)
    items, queries = rng.normal(size=(70, 6)), rng.normal(size=(23, 6))
    items[10] = items[11] = items[12]  # ties go to the smaller id
    items[30:45] = items[3]
    items[50], queries[4] = 0.0, 0.0
    q, i = frames(spark, queries, items)
    i = i.unionByName(spark.createDataFrame([("none", None)], i.schema))
    got = ranked(K.product_top_k(q, i, "q", "i", "v", k=k, block=8, unit=unit))
    length = lambda x: np.where((n := np.linalg.norm(x, axis=1)) > 0, n, 1.0)[:, None] if unit else 1.0
    score = np.floor((queries / length(queries)) @ (items / length(items)).T * 1e6 + 0.5)
    for n in range(23):
        order = sorted(range(70), key=lambda j: (-score[n, j], j))[:k]
        assert [j for j, _ in got[f"q{n:03d}"]] == [f"i{j:03d}" for j in order]
        assert [s for _, s in got[f"q{n:03d}"]] == pytest.approx([score[n, j] / 1e6 for j in order])


def test_top_k_without_rows(spark):
    q, i = frames(spark, np.ones((2, 3)), np.ones((2, 3)))
    assert K.product_top_k(q, i.limit(0), "q", "i", "v").count() == 0
    assert K.product_top_k(q.limit(0), i, "q", "i", "v").count() == 0


def test_blocks_far_away_are_not_visited(spark, monkeypatch):
    """Clustered items: most pairs of packs and blocks are ruled out by their bound."""
    monkeypatch.setattr(K, "PACK", 16)
    rng = np.random.default_rng(6)
    middles = rng.normal(size=(40, 16))
    middles /= np.linalg.norm(middles, axis=1)[:, None]
    items = np.repeat(middles, 20, axis=0) + rng.normal(size=(800, 16)) * 0.02
    queries = middles[rng.integers(0, 40, 200)] + rng.normal(size=(200, 16)) * 0.02
    q, i = frames(spark, queries, items)
    seen = {}
    keep = K.later_visits
    monkeypatch.setattr(K, "later_visits", lambda packs, blocks, *rest: seen.update(packs=packs.count(), blocks=len(blocks.count), later=keep(packs, blocks, *rest).count()) or keep(packs, blocks, *rest))
    got = ranked(K.embedding_top_k(q, i, "q", "i", "v", k=5, block=20))
    assert seen["blocks"] >= 20 and seen["later"] < 0.3 * seen["packs"] * seen["blocks"]
    cos = (queries / np.linalg.norm(queries, axis=1)[:, None]) @ (items / np.linalg.norm(items, axis=1)[:, None]).T
    score = np.floor(cos * 1e6 + 0.5)
    for n in range(200):
        assert [j for j, _ in got[f"q{n:03d}"]] == [f"i{j:03d}" for j in sorted(range(800), key=lambda j: (-score[n, j], j))[:5]]


def test_cosine_by_label(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(12, 4))
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    labels = ["a", "b", "c"] * 4
    df = spark.createDataFrame([(i, labels[i], [float(x) for x in v[i]]) for i in range(12)], "i int, l string, v array<double>")
    for r in L.cosine_by_label(df, "l", "v").collect():
        sims = [unit[i] @ unit[j] for i in range(12) for j in range(12) if i != j and labels[i] == r.label_a and labels[j] == r.label_b]
        assert r.n_pairs == len(sims) and r.mean_similarity == pytest.approx(np.mean(sims))


def test_sample_larger_than_the_table(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "i int, v array<double>")
    got = {(r.a, r.b): r.similarity for r in L.cosine_matrix(rows, "i", "v", n=5000).collect()}
    assert got == {(1, 1): 1.0, (1, 2): 0.0, (2, 1): 0.0, (2, 2): 1.0}
