"""Text operators against brute force written from their definitions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import documents, prose, texts
from pyspark.sql import functions as F

from affinia.llm import decontaminate, langid, licenses, line_dedup, near_text, packing, substring_dedup

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def low(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def white_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def kept_lines(rows, least=10):
    strip = " \t\n\x0b\x0c\r"
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[low(line.strip(strip))].add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(k := low(x.strip(strip))) < least or min(holders[k]) == i]
        out[i] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


@pytest.mark.parametrize("hot", [1000, 1])
def test_line_dedup(spark, docs, hot):
    rows = list(enumerate(texts()))
    want = kept_lines(rows)
    got = line_dedup.keep_bitmaps(docs, hot_lines=hot).collect()
    assert {r["_id"]: r["n_dropped"] for r in got} == {i: d for i, (_, _, d) in want.items() if d}
    if hot == 1000:
        full = line_dedup.drop_repeated_lines(docs)
        assert full.columns[: len(docs.columns)] == docs.columns
        for r in full.collect():
            text, n, dropped = want[r["doc_id"]]
            assert ((r["text"] or ""), r["_n_lines"], r["_n_dropped"]) == (text, n, dropped)


def test_line_dedup_without_ids_and_rows(spark, empty):
    assert line_dedup.drop_repeated_lines(empty).count() == 0
    line = "a line that is long enough"
    rows = [(None, line), (1, line), (2, f"{line}\nx"), (2, f"{line}\ny"), (1, line)]
    got = line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter({(None, line): 1, (1, line): 2, (2, "x"): 1, (2, "y"): 1})


def test_columns_with_the_operators_own_names(spark):
    import corpus_pipeline as cp

    line = "a line that is long enough to be read as prose"
    names = ["_keep_id", "_keep_row", "_keep_runs", "_keep_n", "_n_lines", "_n_dropped", "_language", "_id", "_row"]
    rows = [(i, f"{line}\nand an end of its own {i}", "en", i, *range(len(names))) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n_chars bigint, " + ", ".join(f"{n} int" for n in names))
    got = line_dedup.drop_repeated_lines(docs, lines_col="lines", dropped_col="dropped")
    assert got.columns == [*docs.columns, "lines", "dropped"]
    assert {(r["doc_id"], r["lines"], r["dropped"]) for r in got.collect()} == {(i, 2, min(i, 1)) for i in range(6)}
    for stage in (cp.identify_language, cp.drop_repeated_lines):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        assert [tuple(r)[4:] for r in out.collect()] == [tuple(range(len(names)))] * 6


def shingle_sets(rows, width):
    out = []
    for t in rows:
        w = white_words(low(t))
        out.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    return out


@pytest.mark.parametrize("width, slice_", [(2, 2048), (5, 2048), (2, 3)])
def test_near_text(docs, width, slice_, monkeypatch):
    monkeypatch.setattr(near_text, "SLICE", slice_)
    sets = shingle_sets(texts(), width)
    links = [
        (a, b) for a in range(len(sets)) for b in range(a)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    want = roots(len(sets), links)
    got = {r["doc_id"]: r for r in near_text.near_duplicates(docs, width=width).collect()}
    assert len(got) == len(sets)
    for i, r in got.items():
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), want[i], want[i] == i)


def test_near_text_empty_and_null_ids(spark, empty):
    assert near_text.near_duplicates(empty).count() == 0
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (9, "A b c d e f"), (9, "other text entirely"), (3, None)]
    got = near_text.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert Counter((r["doc_id"], r["component_id"], r["kept"]) for r in got) == Counter(
        [(None, 4, False), (4, 4, True), (9, 4, False), (9, 9, True), (3, 3, True)]
    )


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    common, a, b = (np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (700, 150, 150))
    x, y, u = np.sort(np.r_[common, a]), np.sort(np.r_[common, b]), np.sort(np.r_[common, a, b])
    rx, ry, ru = near_text.registers(np.r_[x, y, u], np.cumsum([0, len(x), len(y), len(u)]))
    assert (near_text.merge(rx, ry) == ru).all()
    got = near_text.estimate(*(np.array([v], float) for v in ((rx > ry).sum(), (rx == ry).sum(), (rx < ry).sum(), len(x), len(y))))
    assert abs(got[0] - 0.7) < 4 * (0.7 * 0.3 / near_text.REGISTERS) ** 0.5


def removed_words(rows, window):
    first = {}
    for i, t in rows:
        w = white_words(t)
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = {}
    for i, t in rows:
        w = white_words(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    return out


@pytest.mark.parametrize("window, chunk", [(13, 8_000_000), (13, 2_000), (6, 700)])
def test_substring_dedup(docs, window, chunk, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 4 * chunk)
    want = removed_words(list(enumerate(texts())), window)
    counts, changed = substring_dedup.remove_repeats(docs, window=window, chunk_bytes=chunk)
    changed = {r["_id"]: r for r in changed.collect()}
    for r in counts.collect():
        n, gone, digest = want[r["_id"]]
        c = changed.get(r["_id"])
        have = (c["n_removed"], hashlib.sha256(c["kept"].encode()).hexdigest()) if c else (0, r["sha256"])
        assert (r["n_words"], *have) == (n, gone, digest)
        assert not c or sum(s["words"] for s in c["spans"]) == gone


def test_substring_dedup_ids(spark, empty):
    assert all(x.count() == 0 for x in substring_dedup.remove_repeats(empty))
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(None, text), (5, text), (5, f"{text} tail"), (7, f"head {text}"), (8, None)]
    counts, changed = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert counts.count() == 5
    assert [(r["_id"], r["n_removed"], r["kept"]) for r in changed.collect()] == [(7, 20, "head")]


def test_language(spark, docs, empty):
    rng = np.random.default_rng(3)
    letters = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "äöüijklm"}

    def text(lang, n):
        return " ".join("".join(rng.choice(list(letters[lang]), 5)) for _ in range(n))

    rows = [(i, text(lang, 12), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 60)] + [(900, None, "aa"), (901, "12 34 !", "bb"), (902, "", None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(frame).select("doc_id", langid.held_out().alias("h"), "_language.*").collect()}
    assert all(r["h"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    out = [(got[i]["lang_pred"] == lang) for i, _, lang in rows[:180] if got[i]["h"]]
    assert sum(out) / len(out) > 0.95
    assert {got[i]["lang_pred"] for i in (900, 901, 902)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in got.values())
    # brute force: the same counts, one text at a time
    names, logs = langid.fit(frame.where(~langid.held_out()))
    for i, t, _ in rows[:20]:
        s = [c.lower() if c.isalpha() else " " for c in t]
        total = np.zeros(len(names))
        for n in langid.ORDERS:
            for k in range(len(s) - n + 1):
                key = np.uint64(ord(s[k]))
                with np.errstate(over="ignore"):
                    for c in s[k + 1 : k + n]:
                        key = key * np.uint64(0x1FFFFF) + np.uint64(ord(c))
                    total += logs[:, int(langid.mix(np.array([key + np.uint64(n)]))[0] & np.uint64(langid.BUCKETS - 1))]
        assert names[int(total.argmax())] == got[i]["lang_pred"]
    assert langid.identify(docs).columns == [*docs.columns, "_language"]
    assert langid.identify(empty).count() == 0


def test_labels_do_not_enter_predictions(spark):
    train = spark.createDataFrame([(1, "abc abd", "x"), (2, "xyz xyw", "y")], "doc_id bigint, text string, lang string")
    ask = spark.createDataFrame([(1, "abc", "y"), (3, "xyz", None)], "doc_id bigint, text string, lang string")
    got = langid.identify(ask, train).select("doc_id", "_language.lang_pred").collect()
    assert dict(got) == {1: "x", 3: "y"}


def test_decontaminate(spark, docs, empty):
    import random

    rng = random.Random(5)
    items = [(k, prose(rng, 24)) for k in range(6)] + [(7, "too short"), (8, None), (9, "")]
    one, two = items[0][1].split(), items[1][1].split()
    moved = " ".join(one[12:] + ["between"] + one[:12]).upper()
    rows = [(1, f"start {items[2][1]} end"), (2, moved), (3, " ".join(two[:9])), (4, None), (5, ""), (6, prose(rng, 300)), (1, f"start {items[2][1]} end")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame(items + items[:1], "item_id bigint, text string")
    for chars in (10**6, 100):  # one block, and several
        got = decontaminate.leaks(frame, bench, block_chars=chars).collect()
        assert Counter((r["doc_id"], r["item_id"]) for r in got) == Counter({(1, 2): 2, (2, 0): 1})
        by = {(r["doc_id"], r["item_id"]): r for r in got}
        assert by[2, 0]["coverage"] == 1.0 and by[2, 0]["n_tiles"] == 2
        assert [tuple(s) for s in by[1, 2]["spans"]] == [(1, 0, 24)]
    assert decontaminate.leaks(empty, bench).count() == 0
    assert decontaminate.leaks(frame, bench.limit(0)).count() == 0
    assert decontaminate.leaks(docs, bench).count() == 0


def greedy(item, text, least):
    """Greedy string tiling, one word at a time."""
    a, b, out = [False] * len(item), [False] * len(text), []
    while True:
        best, found = least - 1, []
        for p in range(len(item)):
            for q in range(len(text)):
                n = 0
                while p + n < len(item) and q + n < len(text) and item[p + n] == text[q + n] and not a[p + n] and not b[q + n]:
                    n += 1
                if n > best:
                    best, found = n, [(p, q)]
                elif n == best and n >= least:
                    found.append((p, q))
        if best < least:
            return out
        for p, q in found:
            if not any(a[p : p + best]) and not any(b[q : q + best]):
                a[p : p + best] = b[q : q + best] = [True] * best
                out.append((p, q, best))


def test_tiles_equal_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(60):
        item, text = (rng.integers(0, 4, rng.integers(1, 26)).astype(np.uint64) for _ in range(2))
        got = decontaminate.tiles(item, text, np.zeros(len(text), bool), 2)
        want = greedy(item.tolist(), text.tolist(), 2)
        assert sorted(n for *_, n in got) == sorted(n for *_, n in want)
        assert all((item[p : p + n] == text[q : q + n]).all() for p, q, n in got)


def test_licenses(spark, docs, empty):
    rows = [
        (1, "Foo. Released under the MIT License. And MIT license again"), (2, "Licensed under CC BY-NC 4.0."),
        (3, "the general public license, apache-license x"), (4, None), (5, ""), (6, "mit licenses, apache é license"),
        (7, "Permission is hereby granted, free of charge, to any person who is obtaining a copy of this software and associated documentation files"),
        (1, "Foo. Released under the MIT License. And MIT license again"),
    ]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i, t in rows:
        w = alnum_words(t)
        places = [(k, label) for phrase, label in licenses.PHRASES.items() for p in [phrase.split()] for k in range(len(w)) if w[k : k + len(p)] == p]
        r = by[i]
        assert (r["n_words"], r["n_base"]) == (len(w), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert (by[2]["labels"], by[2]["score"]) == ("cc-by-nc", 1.0)
    assert by[7]["labels"] == "mit" and by[7]["score"] >= 0.8  # two inserted words leave one span
    assert licenses.scan_licenses(empty).count() == 0
    assert licenses.scan_licenses(docs).count() == docs.count()


def tokenizer():
    from tokenizers import Tokenizer

    from affinia.llm.queries import tokenizer_path

    return Tokenizer.from_file(tokenizer_path())


def check_packing(rows, pieces, capacity):
    tok = tokenizer()
    want = Counter()
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((p["doc_id"], p["piece"], p["start"], p["length"], p["ids_crc32"]) for p in pieces) == want
    spans = defaultdict(list)
    for p in pieces:
        spans[p["sequence_id"]].append((p["offset"], p["length"]))
    for s in spans.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    return len(spans)


def decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


@pytest.mark.parametrize("capacity", [4096, 64])
def test_packing(docs, empty, capacity):
    from affinia.llm.queries import tokenizer_path

    rows = list(enumerate(texts()))
    pieces = packing.pack(docs, tokenizer_path(), capacity=capacity).collect()
    assert check_packing(rows, pieces, capacity) == decreasing([p["length"] for p in pieces], capacity)
    assert packing.pack(empty, tokenizer_path()).count() == 0


def test_word_ids_equal_whole_texts():
    from affinia.llm.queries import tokenizer_path
    from affinia.llm.words import utf8
    import pyarrow as pa

    odd = ["It's A b'c <|endoftext|>x", "é ́x y　z", "ΑΣ ΑΣ. İI", "a b 12 345\tq", None, " \n ", "日本語 テスト"]
    ids, borders = packing.WordIds(tokenizer_path()).ids(*utf8(pa.array(odd, pa.string())))
    for k, t in enumerate(odd):
        assert ids[borders[k] : borders[k + 1]].tolist() == tokenizer().encode(t or "", add_special_tokens=False).ids


def test_best_fit_equals_one_by_one():
    rng = np.random.default_rng(4)
    for _ in range(50):
        capacity = int(rng.integers(1, 40))
        counts = np.r_[0, rng.integers(0, 6, capacity)]
        lengths = np.repeat(np.arange(capacity + 1), counts)
        rank = np.concatenate([np.arange(c) for c in counts])
        sequence, offset = packing.best_fit(counts).place(lengths, rank)
        assert len(np.unique(sequence)) == decreasing(lengths.tolist(), capacity)
        used = Counter()
        for s, o, n in sorted(zip(sequence.tolist(), offset.tolist(), lengths.tolist())):
            assert used[s] == o
            used[s] += n
        assert not used or max(used.values()) <= capacity


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    rng = __import__("random").Random(11)
    rows = [(i, t) for i, t in enumerate(texts(3))]
    item = prose(rng, 30)
    rows += [(1000, f"{prose(rng, 30)} {item} {prose(rng, 5)}"), (1001, "!!! 12 ---"), (None, prose(rng, 20))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    first = cp.identify_language(spark, docs, str(tmp_path))
    assert first.columns == docs.columns
    have = [(r["doc_id"], r["text"]) for r in first.collect()]
    want = [(i, t) for i, t in rows if any(c.isalpha() for c in t or "")]
    assert Counter(have) == Counter(want)
    second = cp.drop_repeated_lines(spark, first, str(tmp_path))
    lines = kept_lines([(i, t) for i, t in want if i is not None])
    want = [(i, lines[i][0] if i is not None else t) for i, t in want]
    want = [(i, t) for i, t in want if t.strip(" \t\n\v\f\r")]
    got = second.collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(want) and all(r["n_chars"] == len(r["text"]) for r in got)
    third = cp.drop_near_duplicates(spark, second, str(tmp_path))
    sets = shingle_sets([t for _, t in rows], 5)
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    group = dict(zip([i for i, _ in rows], roots(len(rows), links)))
    first = {}
    for i, _ in sorted(want, key=lambda w: (w[0] is None, w[0])):
        first.setdefault(group[i], i)
    want = [w for w in want if first[group[w[0]]] == w[0]]
    assert Counter((r["doc_id"], r["text"]) for r in third.collect()) == Counter(want)
    fourth = cp.drop_leaks(spark, third, str(tmp_path))
    want = [w for w in want if w[0] != 1000]
    assert Counter((r["doc_id"], r["text"]) for r in fourth.collect()) == Counter(want)
    assert check_packing(want, cp.run(spark, str(tmp_path)).collect(), 4096) >= 1


def test_pipeline_judges_rows_that_share_an_id_by_their_texts(spark, tmp_path):
    import corpus_pipeline as cp

    rng = __import__("random").Random(5)
    copied, leaked, clean, clean_2, own = (prose(rng, 40) for _ in range(5))
    spark.createDataFrame([(1, leaked)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, copied), (5, copied), (5, clean), (None, copied), (None, own), (7, leaked), (7, clean_2), (None, leaked), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    apart = cp.drop_near_duplicates(spark, docs, str(tmp_path))
    assert apart.columns == docs.columns
    kept = [(1, copied), (5, clean), (None, own), (7, leaked), (7, clean_2), (None, None)]
    assert Counter((r["doc_id"], r["text"]) for r in apart.collect()) == Counter(kept)
    clear = cp.drop_leaks(spark, docs, str(tmp_path))
    assert Counter((r["doc_id"], r["text"]) for r in clear.collect()) == Counter(r for r in rows if r[1] != leaked)


def test_pipeline_keeps_short_and_unlabelled_documents(spark):
    import corpus_pipeline as cp

    tongues = ["en", "de", "fr", "nl", "sv"]
    rows = [(i, f"a b c d e {t} " * 9, t) for i, t in enumerate(tongues * 4)] + [(100, "a b", None), (101, "12 --", None)]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t)) for i, t, lang in rows], SCHEMA)
    got = cp.identify_language(spark, docs, "")
    assert {r["doc_id"] for r in got.collect()} == {i for i, _, _ in rows} - {101}
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert cp.identify_language(spark, unlabelled, "").count() == len(rows)


def test_pipeline_catches_copies_that_line_dedup_emptied(spark, tmp_path):
    """Near copies that share most lines go as a group, and no empty or torn text of a copy stays."""
    import corpus_pipeline as cp

    rng = __import__("random").Random(21)
    rows = []
    for g in range(6):
        lines = [prose(rng, 14) for _ in range(12)]
        rows.append((10 * g, "\n".join(lines)))
        for c in range(1, 5):  # one line changed, or an exact copy
            copy = list(lines)
            if c < 4:
                copy[c] = prose(rng, 14)
            rows.append((10 * g + c, "\n".join(copy)))
    rows += [(900 + i, prose(rng, 50)) for i in range(10)] + [(990, None), (991, "")]
    docs = spark.createDataFrame([(i, t, [None, "en"][i % 2], "s", len(t or "")) for i, t in rows], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    first = cp.identify_language(spark, docs, str(tmp_path))
    assert {r["lang"] for r in first.collect()} == {"en"}  # the label that was missing is predicted
    third = cp.drop_near_duplicates(spark, cp.drop_repeated_lines(spark, first, str(tmp_path)), str(tmp_path))
    assert {(r["doc_id"], r["text"]) for r in third.collect()} == {r for r in rows if r[1] and (r[0] >= 900 or r[0] % 10 == 0)}


def test_pipeline_catches_copies_that_line_dedup_made(spark, tmp_path):
    """Documents that differ only in lines that line dedup takes out are near copies of each other afterwards."""
    import corpus_pipeline as cp

    rng = __import__("random").Random(33)
    frames = [[prose(rng, 14) for _ in range(12)] for _ in range(3)]
    body, other = prose(rng, 80).split(), prose(rng, 80)
    edited = [*body[:40], "changed", *body[41:]]
    rows = [(i, "\n".join(f)) for i, f in enumerate(frames)]
    rows += [(10, "\n".join([*frames[0], " ".join(body)])), (11, "\n".join([*frames[1], " ".join(edited)])), (12, "\n".join([*frames[2], other]))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    left = cp.drop_near_duplicates(spark, cp.drop_repeated_lines(spark, docs, str(tmp_path)), str(tmp_path))
    assert {(r["doc_id"], r["text"]) for r in left.collect()} == {*rows[:3], (10, " ".join(body)), (12, other)}


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline as cp

    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
