"""Centroids, quality rules and fill-in-middle against plain computations on small tables."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from fixtures import documents
from pyspark.sql import functions as F

from affinia.llm import centroids, fim, quality_rules

# ---- centroids


def plain_lloyd(rows, k, rounds, dim, scale):
    """(id, vector) of the usable rows, their clusters and distances, and the centroids, in Python integers."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(scale * x) for x in v]))

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))

    drawn = sorted(kept, key=lambda r: hashlib.sha256(f"1:{r[0]}".encode()).hexdigest())
    cents = [v for _, v in drawn[:k]]
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for c in set(own):
            mine = [v for (_, v), o in zip(kept, own) if o == c]
            cents[c] = [sum(x) // len(mine) for x in zip(*mine)]
    return [(i, *nearest(v)) for i, v in kept], cents


def vector_rows(seed=3):
    rng = np.random.default_rng(seed)
    middles = rng.standard_normal((5, 64)) * 2
    rows = [(m + rng.standard_normal(64) * 0.05).tolist() for m in middles for _ in range(30)]
    rows += rng.standard_normal((60, 64)).tolist()
    rows += [rows[0]] * 90  # a hot vector
    rows += [None, [], [1.0] * 63, [1.0] * 65, [math.nan, *[1.0] * 63], [math.inf, *[1.0] * 63], [None, *[1.0] * 63]]
    rows += [[0.0] * 64, [-0.0] * 64, [2.0e5, *[0.0] * 63], [-2.0e6, *[1.0] * 63]]
    return list(enumerate(rows))


@pytest.mark.parametrize("zone,k", [(128, 16), (4, 16), (7, 3)])
def test_centroids(spark, zone, k, monkeypatch):
    monkeypatch.setattr(centroids.zones, "__defaults__", (zone,))
    rows = vector_rows()
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "'x' AS cluster", "1 AS key").repartition(5)
    got, cents = centroids.cluster(frame, k=k)
    got = {r["vec_id"]: r for r in got.collect()}
    want, want_cents = plain_lloyd(rows, k, 3, 64, 64)
    assert cents.tolist() == want_cents
    assert {i: (r["distance"], r["cluster"]) for i, r in got.items()} == {i: (d, c) for i, d, c in want}
    total = Counter()
    for _, d, c in want:
        total[c] += d
    for r in got.values():
        assert (r["cluster_inertia"], r["inertia"]) == (total[r["cluster"]], sum(total.values()))
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, want_cents[r["cluster"]])).encode()).hexdigest()


def test_centroids_of_few_and_odd_rows(spark):
    schema = "vec_id bigint, embedding array<float>"
    few = spark.createDataFrame([(1, [0.5] * 64), (1, [0.5] * 64), (None, [0.25] * 64)], schema)
    got, cents = centroids.cluster(few)
    assert len(cents) == 3  # a null id is drawn as ids ran out
    assert sorted((r["vec_id"] or 0, r["cluster"], r["distance"]) for r in got.collect()) == [(0, 2, 0), (1, 0, 0), (1, 0, 0)]
    for rows in ([], [(1, None), (2, [1.0])]):
        got, cents = centroids.cluster(spark.createDataFrame(rows, schema))
        assert got.count() == 0 and len(cents) == 0 and got.columns[0] == "vec_id"
    huge = spark.createDataFrame([(1, [1e300] * 64), (2, [-1e300] * 64), (3, [0.0] * 64)], "vec_id bigint, embedding array<double>")
    got = {r["vec_id"]: r["distance"] for r in centroids.cluster(huge, k=1, rounds=0)[0].collect()}
    assert max(got.values()) <= 64 * (2 * centroids.LARGEST) ** 2 < 1 << 63


def test_hilbert_steps_to_neighbours():
    for axes, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
        key = centroids.hilbert(cells, bits)
        assert sorted(key) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_boxes_rule_out_no_nearest_centroid_and_most_others():
    rng = np.random.default_rng(4)
    cents = rng.integers(-60, 60, (16, 64))
    left = 0
    for _ in range(200):
        box = cents[rng.integers(16)] + rng.integers(-8, 9, (50, 64))
        among = centroids.candidates(box.min(axis=0), box.max(axis=0), cents)
        every, exact = centroids.nearest(box, cents, np.arange(16)), centroids.nearest(box, cents, among)
        assert (every[0] == exact[0]).all() and (every[1] == exact[1]).all()
        left += len(among)
    assert left <= 220  # of 3200
    same = np.vstack([cents[:1], cents])  # equal centroids: the smaller number
    assert centroids.candidates(cents[0], cents[0], same).tolist() == [0]


# ---- quality rules


def plain_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(5)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
        "base_failed": len(words) < 10 or 100 * len(covered) > 20 * len(words),
    }


def char_class(c):
    for k, pattern in enumerate(["[a-z]", "[A-Z]", "[0-9]", r"[\x20\x09-\x0D]", r"[.,;:!?'\"()-]", r"[#*$%&|<>]", r"[\x00-\x7F]", "[\x80-ɏ]", "."]):
        if re.fullmatch(pattern, c, re.S):
            return k


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def jensen_shannon(p, q):
    def info(a, b):
        return sum(a[k] * math.log2(2 * a[k] / (a[k] + b.get(k, 0))) for k in a if a[k] > 0)

    return math.sqrt(max(0, (info(p, q) + info(q, p)) / 2))


def test_quality_measures():
    rng = random.Random(5)
    texts = [None, "", " \n\t\n", "a a a a a a", "one\none\n one\n\n\none", "ɏ é ɐ 漢 😀 # | <b>", "x" * 3000 + " y", "\n".join(["long line " * 80] * 3)]
    texts += ["".join(rng.choice("ab \n#Zé1!") for _ in range(rng.randrange(200))) for _ in range(150)]
    found = quality_rules.measure(pa.array(texts))
    for i, text in enumerate(texts):
        want = plain_measures(text)
        assert {c: getattr(found, c)[i] for c in want} == want
        classes = Counter(map(char_class, text or ""))
        assert found.classes[i].tolist() == [classes[k] for k in range(quality_rules.N_CLASSES)]
        assert found.n_tokens[i] == len(tokens(text))


LANGS = {"en": "the of and to cat dog house river stone sun".split(), "fr": "le la et un chat chien maison fleuve pierre été".split()}


def language_rows(seed=6):
    rng = random.Random(seed)
    rows = []
    for i in range(160):
        lang = ["en", "fr"][i % 2]
        words = [rng.choice(LANGS[lang]) + (str(rng.randrange(30)) if rng.random() < 0.4 else "") for _ in range(rng.choice([45, 80, 200]))]
        words = [w.capitalize() if rng.random() < 0.1 else w for w in words]
        if i % 10 == 3:
            words = [w + rng.choice(["###", "&&&", "$$$"]) for w in words]
        rows.append((i, " ".join(words), [lang, lang, None, "", "xx" if i == 159 else lang][i % 5]))
    rows += [(900, None, "en"), (901, "", None), (902, "too short", "fr"), (903, "the THE. " * 300, "en"), (903, rows[0][1], "fr"), (None, rows[1][1], None)]
    return rows


def plain_references(rows, good):
    by = {}
    for (_, text, lang), ok in zip(rows, good):
        if lang:
            by.setdefault(lang, []).append((text or "", ok))
    total = sum(len(tokens(text)) for _, text, _ in rows)
    out = {}
    for lang, texts in by.items():
        every = Counter(w for t, _ in texts for w in tokens(t))
        size = sum(every.values())
        if size < quality_rules.LANGUAGE_SHARE * total:
            continue
        kept = Counter(w for t, ok in texts if ok for w in tokens(t))
        classes = Counter(c for t, ok in texts if ok for c in map(char_class, t))
        if kept:
            shares = {w: kept[w] / sum(kept.values()) for w in every if every[w] >= quality_rules.COMMON * size and kept[w]}
            out[lang] = ({c: n / sum(classes.values()) for c, n in classes.items()}, shares)
    return out


def plain_distances(text, references):
    text, words = text or "", tokens(text)
    best = None
    for lang in sorted(references):
        classes, shares = references[lang]
        char = word = None
        if len(text) >= quality_rules.MIN_CHARS:
            char = jensen_shannon({c: n / len(text) for c, n in Counter(map(char_class, text)).items()}, classes)
        if len(words) >= quality_rules.MIN_WORDS:
            p = {w: n / len(words) for w, n in Counter(words).items() if w in shares}
            p[""], q = 1 - sum(p.values()), dict(shares)
            q[""] = 1 - sum(shares.values())
            word = jensen_shannon(p, q)
        if char is None and word is None:
            continue
        fit = ((char or 0) ** 2 + (word or 0) ** 2, lang, char, word)
        best = min(best or fit, fit)
    return best[1:] if best else (None, None, None)


@pytest.mark.parametrize("chunk", [1_000_000, 50])
def test_quality_against_plain_computation(spark, chunk, monkeypatch):
    monkeypatch.setattr(quality_rules, "CHUNK_WORDS", chunk)
    rows = language_rows()
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "1 AS kept", "'z' AS n_words").repartition(6)
    base = [plain_measures(text) for _, text, _ in rows]
    good = [
        not b["base_failed"] and len(t or "") >= quality_rules.MIN_CHARS and len(tokens(t)) >= quality_rules.MIN_WORDS
        for b, (_, t, _) in zip(base, rows)
    ]
    first = plain_references(rows, good)
    for i, (_, text, _) in enumerate(rows):
        if good[i]:
            _, char, word = plain_distances(text, first)
            good[i] = char <= quality_rules.MAX_CHAR_DISTANCE and word <= quality_rules.MAX_WORD_DISTANCE
    references = plain_references(rows, good)
    got = quality_rules.judge(frame).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "text", "lang", "kept", "n_words", "_quality"}
    by_row = {(r["doc_id"], r["text"]): r["_quality"] for r in got}
    for (i, text, _), b in zip(rows, base):
        r = by_row[i, text]
        lang, char, word = plain_distances(text, references)
        assert {c: r[c] for c in b} == b and r["reference"] == lang
        assert r["char_distance"] == pytest.approx(char, abs=1e-6) and r["word_distance"] == pytest.approx(word, abs=1e-6)
        far = (char or 0) > quality_rules.MAX_CHAR_DISTANCE or (word or 0) > quality_rules.MAX_WORD_DISTANCE
        assert r["kept"] == (not b["base_failed"] and not far)
    verdict = {i: by_row[i, text]["kept"] for i, text, _ in rows[:160]}
    assert all(verdict[i] != (i % 10 == 3) for i in verdict)  # clean texts stay, texts full of symbols go


def test_quality_without_labels_and_rows(spark):
    rows = [(i, text, None) for i, text, _ in language_rows()]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert {r["_quality"]["reference"] for r in quality_rules.judge(frame).collect()} == {quality_rules.UNLABELLED, None}
    assert quality_rules.judge(frame.drop("lang"), lang_col=None).count() == len(rows)
    assert quality_rules.judge(frame.limit(0)).count() == 0
    blank = quality_rules.judge(frame.selectExpr("doc_id", "CAST(NULL AS string) AS text", "lang")).collect()
    assert all(r["_quality"]["base_failed"] and r["_quality"]["reference"] is None and not r["_quality"]["kept"] for r in blank)


# ---- fill in the middle


def plain_fim(i, text):
    text = text or ""
    hexed = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(hexed[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(text), "plain", None, None, text
    a, b = sorted((h[0] % (len(text) + 1), h[1] % (len(text) + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return len(text), "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return len(text), "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark):
    frame = documents(spark)
    odd = [(None, "no id at all"), (7, "<M> stands here"), (8, "é<S"), (9, "😀" * 50), (10, "x" * 300_000 + "ü" * 9), (10, "again ten")]
    frame = frame.unionByName(spark.createDataFrame(odd, "doc_id bigint, text string"), allowMissingColumns=True).withColumn("_fim", frame["n_chars"])
    turned = fim.fill_in_middle(frame, out_col="turned")
    rows = turned.withColumn("back", fim.restored(F.col("turned.output"), F.col("turned.form"))).collect()
    assert len(rows) == frame.count()
    for r in rows:
        t = r["turned"]
        assert (t["n"], t["form"], t["prefix_chars"], t["middle_chars"], t["output"]) == plain_fim(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "") and r["_fim"] == r["n_chars"]
    assert {r["turned"]["form"] for r in rows} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(frame.limit(0)).count() == 0


def test_rotation_exchanges_blocks():
    for n in range(8):
        for cut in range(n + 1):
            block = np.arange(n)
            fim.rotate(block, cut)
            assert block.tolist() == [*range(cut, n), *range(cut)]


def test_round_trip_of_texts_like_sentinels():
    rng = random.Random(8)
    for i in range(4000):
        text = "".join(rng.choice("<P>SMé") for _ in range(rng.randrange(14)))
        n, form, prefix, middle, output = fim.transform(text.encode(), "1", i)
        assert (n, form, prefix, middle, output.decode()) == plain_fim(i, text)
        assert fim.restore(output, form) == text.encode()
