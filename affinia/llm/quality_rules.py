"""Quality rules: how far a document's histograms lie from those of its language.

Two histograms describe a text: its code points by class, and its words (runs of
ASCII letters and digits and of everything beyond ASCII, A-Z lower-cased) by the
common words of a language, all others being one bin. A reference is the sum of
the histograms of a language's documents that pass the base rules and the length
guards, taken twice: the second time without those far from the first sums. A document is held against the reference that fits it best, by the
Jensen-Shannon distance (root of the divergence in bits, 0 to 1) of both
histograms; a histogram of fewer than `MIN_CHARS` code points or `MIN_WORDS`
words says nothing and is not judged. Labels choose references, never verdicts,
so unlabelled and mislabelled documents are judged by their text.

A common word holds at least `COMMON` of the words of its language. They are found
exactly: a word that common holds at least that share of some chunk
of the language's words, so chunks report words above a quarter of it, and only
words whose upper bound reaches `COMMON`, at most 4/3 / COMMON a language, are
counted in the next scan. A language has a reference of its own if it holds at
least `LANGUAGE_SHARE` of all words, so there are at most 1 / LANGUAGE_SHARE, and
all that reaches the driver or is broadcast is bounded by these two numbers. If no
label reaches it, all documents make one reference, `UNLABELLED`, of classes alone.

The base rules: fewer than `LEAST_WORDS` words fail, and more than `REPEAT_PERCENT`
of the words in 5-word windows that occur twice or more in the text.

Defined results: null texts count as empty, fail the base rule and have null
distances; null and "" labels are no labels; rows that repeat an id are judged
each by its text and count each in the references; a text so long that it is a
batch of its own is still judged whole; an empty table gives an empty table. All
columns of the caller stay; the result is one struct, in place of a column of that name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinia.llm.words import LOWER, NOT_ALNUM, WHITE, Words, mix, pieces, utf8, words_of

COMMON = 0.005
LANGUAGE_SHARE = 0.002
MIN_CHARS, MIN_WORDS = 200, 40
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.2, 0.36
LEAST_WORDS, REPEAT_WINDOW, REPEAT_PERCENT = 10, 5, 20
UNLABELLED = "all"
CHUNK_WORDS = 1_000_000
MAX_LABELS_HELD = 64

LINE_END = np.zeros(256, dtype=bool)
LINE_END[10] = True
SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(b"#*$%&|<>")] = True

# Classes of code points, by the first byte of their UTF-8 form: lower case, upper case, digit, white space, punctuation
# of prose, symbol, other ASCII, U+0080 to U+024F (Latin with marks), and beyond; continuation bytes have none.
N_CLASSES = 9
NO_CLASS = 255
CLASS = np.full(256, NO_CLASS, np.uint8)
CLASS[:128] = 6
CLASS[ord("a") : ord("z") + 1] = 0
CLASS[ord("A") : ord("Z") + 1] = 1
CLASS[ord("0") : ord("9") + 1] = 2
CLASS[WHITE] = 3
CLASS[list(b".,;:!?'\"()-")] = 4
CLASS[SYMBOL] = 5
CLASS[0xC2:0xC9] = 7
CLASS[0xC9:0xF8] = 8  # U+0240 to U+024F begin with 0xC9 as well, and are looked at again

JUDGED = (
    "struct<n_words: bigint, word_chars: bigint, n_symbols: bigint, n_dup_lines: bigint, n_repeat_words: bigint, base_failed: boolean, "
    "reference: string, char_distance: double, word_distance: double, kept: boolean>"
)


def _between(marks: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """How many marks each text holds."""
    return np.diff(np.concatenate([[0], np.cumsum(marks)])[borders])


def _class_counts(data: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """[text, class] code points."""
    kind = CLASS[data]
    edge = np.flatnonzero(data[:-1] == 0xC9)
    kind[edge[data[edge + 1] <= 0x8F]] = 7
    return np.stack([_between(kind == c, borders) for c in range(N_CLASSES)], axis=1)


def _repeated_in_text(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether an entry's key occurs twice in its text, and whether it is not the first."""
    both = mix(key ^ mix(doc.astype(np.uint64) + np.uint64(1)))
    _, first, inverse, count = np.unique(both, return_index=True, return_inverse=True, return_counts=True)
    later = np.ones(len(key), bool)
    later[first] = False
    return count[inverse] > 1, later


@dataclass
class Measures:
    """What the rules look at, per text of a batch."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    classes: np.ndarray
    tokens: Words

    @property
    def n_tokens(self) -> np.ndarray:
        return np.diff(self.tokens.first)

    @property
    def n_chars(self) -> np.ndarray:
        return self.classes.sum(axis=1)

    @property
    def base_failed(self) -> np.ndarray:
        return (self.n_words < LEAST_WORDS) | (100 * self.n_repeat_words > REPEAT_PERCENT * self.n_words)


def measure(texts: pa.Array) -> Measures:
    data, borders = utf8(texts)
    n = len(borders) - 1
    heads = (data & 0xC0) != 0x80
    solid = ~WHITE[data]
    words = words_of(data, borders, WHITE)
    at, key = words.rolling(REPEAT_WINDOW)
    twice, _ = _repeated_in_text(words.doc[at], key)
    step = np.zeros(len(words.hash) + 1, np.int64)
    np.add.at(step, at[twice], 1)
    np.add.at(step, at[twice] + REPEAT_WINDOW, -1)
    inside = np.cumsum(step)[:-1] > 0
    lines = words_of(data, borders, LINE_END)
    before = np.concatenate([[0], np.cumsum(solid)])
    full = before[lines.end] > before[lines.start]
    _, again = _repeated_in_text(lines.doc[full], lines.hash[full])
    return Measures(
        np.diff(words.first), _between(heads & solid, borders), _between(SYMBOL[data], borders),
        np.bincount(lines.doc[full][again], minlength=n), np.bincount(words.doc[inside], minlength=n),
        _class_counts(data, borders), words_of(LOWER[data], borders, NOT_ALNUM),
    )


def _labels(column: pa.Array) -> tuple[list[str], np.ndarray]:
    """Distinct labels and the index of each row's label; no label is ""."""
    coded = column.fill_null("").dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n, of): words above a quarter of COMMON in a chunk of a language's words; a null word counts the chunk."""
    held: dict[str, list[np.ndarray]] = {}
    size: dict[str, int] = {}

    def flush(lang: str) -> pa.RecordBatch:
        word, n = np.unique(np.concatenate(held.pop(lang)), return_counts=True)
        of = size.pop(lang)
        often = n >= COMMON / 4 * of
        word, n = word[often].view(np.int64), n[often]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * (len(n) + 1), pa.string()), pa.array([None, *word.tolist()], pa.int64()),
                pa.array(np.append(of, n)), pa.array(np.full(len(n) + 1, of)),
            ],
            ["lang", "word", "n", "of"],
        )

    for batch in pieces(batches, "text"):
        data, borders = utf8(batch.column("text"))
        tokens = words_of(LOWER[data], borders, NOT_ALNUM)
        names, code = _labels(batch.column("lang"))
        of_token = code[tokens.doc]
        for k, name in enumerate(names):
            mine = tokens.hash[of_token == k]
            if not len(mine):
                continue
            held.setdefault(name, []).append(mine)
            size[name] = size.get(name, 0) + len(mine)
            if size[name] >= CHUNK_WORDS:
                yield flush(name)
        if len(held) > MAX_LABELS_HELD:
            for name in list(held):
                yield flush(name)
    for name in list(held):
        yield flush(name)


@dataclass
class References:
    """Per language the class shares, and the numbers in `vocabulary` and the shares of its common words."""

    vocabulary: np.ndarray  # sorted hashes
    names: list[str] = field(default_factory=list)
    classes: list[np.ndarray] = field(default_factory=list)
    words: list[np.ndarray] = field(default_factory=list)
    shares: list[np.ndarray] = field(default_factory=list)


def _candidates(rows: DataFrame) -> dict[str, np.ndarray]:
    """Languages with a reference of their own, and the words that may be common in them."""
    reports = rows.mapInArrow(_chunks, "lang string, word bigint, n bigint, of bigint")
    sums = reports.groupBy("lang", "word").agg(F.sum("n").alias("n"), F.sum("of").alias("of"))
    spark = rows.sparkSession
    whole = sums.where("word is null")
    total = whole.agg(F.sum("n")).first()[0] or 0
    large = whole.where((F.col("lang") != "") & (F.col("n") >= LANGUAGE_SHARE * total)).select(F.col("lang").alias("own"), F.col("n").alias("whole"))
    names = {r["own"]: r["whole"] for r in large.collect()}  # at most 1 / LANGUAGE_SHARE
    if not names:
        return {}
    sizes = spark.createDataFrame(list(names.items()), "own string, whole bigint")
    bound = F.col("n") + COMMON / 4 * (F.col("whole") - F.col("of")) >= COMMON * F.col("whole")
    found = sums.where("word is not null").join(F.broadcast(sizes), F.col("lang") == F.col("own")).where(bound).select("lang", "word")
    out: dict[str, list[int]] = {name: [] for name in names}
    for r in found.collect():  # at most 4/3 / COMMON words a language
        out[r["lang"]].append(r["word"])
    return {name: np.sort(np.array(out[name], np.int64).view(np.uint64)) for name in sorted(out)}


def _entries(vocabulary: np.ndarray, tokens: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, number, count) of the words of sorted `vocabulary` in each text."""
    if not len(vocabulary):
        return (np.zeros(0, np.int64),) * 3
    at = np.minimum(np.searchsorted(vocabulary, tokens.hash), len(vocabulary) - 1)
    hit = vocabulary[at] == tokens.hash
    cell, count = np.unique(tokens.doc[hit] * len(vocabulary) + at[hit], return_counts=True)
    return cell // len(vocabulary), cell % len(vocabulary), count


def _histograms(rows: DataFrame, words: dict[str, np.ndarray], vocabulary: np.ndarray, near: References | None) -> References:
    """References from the documents that pass the base rules and the guards and, if given, lie near the references `near`."""
    names = list(words)
    own = [np.searchsorted(vocabulary, words[name]) for name in names]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(name, slot, n_all, n_good): slots are classes, the number of words, then words."""
        for batch in pieces(batches, "text"):
            found = measure(batch.column("text"))
            good = ~found.base_failed & (found.n_chars >= MIN_CHARS) & (found.n_tokens >= MIN_WORDS)
            if near is not None:
                _, char, word = best_reference(found, near)
                good &= (char <= MAX_CHAR_DISTANCE) & (word <= MAX_WORD_DISTANCE)
            doc, at, count = _entries(vocabulary, found.tokens)
            labels, code = _labels(batch.column("lang"))
            for k, label in enumerate(labels):
                if label not in words:
                    continue
                name = names.index(label)
                sums = []
                for some in (code == k, (code == k) & good):
                    entry = some[doc]
                    each = np.bincount(at[entry], count[entry], minlength=len(vocabulary))[own[name]]
                    sums.append(np.concatenate([found.classes[some].sum(axis=0), [found.n_tokens[some].sum()], each]).astype(np.int64))
                used = np.flatnonzero(sums[0])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(used), name, np.int32)), pa.array(used.astype(np.int32)),
                        pa.array(sums[0][used]), pa.array(sums[1][used]),
                    ],
                    ["name", "slot", "n_all", "n_good"],
                )

    counted = rows.mapInArrow(scan, "name int, slot int, n_all bigint, n_good bigint")
    totals = counted.groupBy("name", "slot").agg(F.sum("n_all").alias("n_all"), F.sum("n_good").alias("n_good"))
    n_all = [np.zeros(N_CLASSES + 1 + len(at), np.int64) for at in own]
    n_good = [x.copy() for x in n_all]
    for r in totals.collect():  # a few hundred numbers a language
        n_all[r["name"]][r["slot"]], n_good[r["name"]][r["slot"]] = r["n_all"], r["n_good"]
    out = References(vocabulary)
    for name, at, each, good in zip(names, own, n_all, n_good):
        if not good[N_CLASSES]:
            continue  # no document that can serve as a reference
        common = (each[N_CLASSES + 1 :] >= COMMON * each[N_CLASSES]) & (good[N_CLASSES + 1 :] > 0)
        out.names.append(name)
        out.classes.append(good[:N_CLASSES] / good[:N_CLASSES].sum())
        out.words.append(at[common])
        out.shares.append(good[N_CLASSES + 1 :][common] / good[N_CLASSES])
    return out


def fit(docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang") -> References:
    """References from all rows of `docs`: first from all that may serve, then from those that lie near these."""
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("")) if lang_col else F.lit("")
    rows = docs.select(F.col(text_col).alias("text"), lang.alias("lang"))
    words = _candidates(rows)
    if not words:  # several languages may be mixed: only the classes are compared
        rows = rows.withColumn("lang", F.lit(UNLABELLED))
        words = {UNLABELLED: np.zeros(0, np.uint64)}
    vocabulary = np.unique(np.concatenate([*words.values(), np.zeros(0, np.uint64)]))
    first = _histograms(rows, words, vocabulary, None)
    second = _histograms(rows, words, vocabulary, first)
    for k, name in enumerate(first.names):
        if name not in second.names:  # none lies near: the first sums stay
            second.names.append(name)
            for part in ("classes", "words", "shares"):
                getattr(second, part).append(getattr(first, part)[k])
    return second


def _information(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x log2(x / mean of x and y), 0 where x is 0."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(x > 0, x * np.log2(2 * x / (x + y)), 0.0)


def _divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Terms of the Jensen-Shannon divergence."""
    return (_information(p, q) + _information(q, p)) / 2


def best_reference(found: Measures, references: References) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text the number of the reference with the least sum of divergences, and both distances (NaN below a guard)."""
    n = len(found.n_words)
    chars, tokens = np.maximum(found.n_chars, 1), np.maximum(found.n_tokens, 1)
    few_chars, few_words = found.n_chars < MIN_CHARS, found.n_tokens < MIN_WORDS
    best, least = np.full(n, -1), np.full(n, np.inf)
    char, word = np.full(n, np.nan), np.full(n, np.nan)
    doc, at, count = _entries(references.vocabulary, found.tokens)
    share = np.zeros(len(references.vocabulary))
    for k, (classes, words, shares) in enumerate(zip(references.classes, references.words, references.shares)):
        by_class = _divergence(found.classes / chars[:, None], classes[None, :]).sum(axis=1)
        share[words] = shares
        own = share[at] > 0
        mine, p, q = doc[own], count[own] / tokens[doc[own]], share[at[own]]
        share[words] = 0
        unseen = shares.sum() - np.bincount(mine, q, minlength=n)  # common words that the text lacks
        rest = 1 - np.bincount(mine, count[own], minlength=n) / tokens
        by_word = np.bincount(mine, _divergence(p, q), minlength=n) + np.maximum(unseen, 0) / 2 + _divergence(rest, 1 - shares.sum())
        by_class[few_chars], by_word[few_words] = np.nan, np.nan
        total = np.nan_to_num(by_class) + np.nan_to_num(by_word)
        nearer = (total < least) & ~(few_chars & few_words)
        best[nearer], least[nearer] = k, total[nearer]
        char[nearer], word[nearer] = np.sqrt(np.maximum(by_class[nearer], 0)), np.sqrt(np.maximum(by_word[nearer], 0))
    return best, char, word


def verdicts(texts: pa.Array, references: References) -> pa.StructArray:
    found = measure(texts)
    best, char, word = best_reference(found, references)
    names = np.array([*references.names, None], object)[best]
    failed = found.base_failed
    kept = ~failed & ~(char > MAX_CHAR_DISTANCE) & ~(word > MAX_WORD_DISTANCE)
    columns = [found.n_words, found.word_chars, found.n_symbols, found.n_dup_lines, found.n_repeat_words]
    return pa.StructArray.from_arrays(
        [
            *(pa.array(c.astype(np.int64)) for c in columns), pa.array(failed), pa.array(names, pa.string()),
            pa.array(char, pa.float64(), from_pandas=True), pa.array(word, pa.float64(), from_pandas=True), pa.array(kept),
        ],
        ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "reference", "char_distance", "word_distance", "kept"],
    )


def judge(docs: DataFrame, references: References | None = None, text_col: str = "text", lang_col: str | None = "lang", out_col: str = "_quality") -> DataFrame:
    """All rows and columns of `docs`, and `out_col` = the measures and the verdict of every text.

    The references are those of `docs` itself unless others are given.
    """
    references = references if references is not None else fit(docs, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(references)

    @F.arrow_udf(JUDGED)
    def look(texts: pa.Array) -> pa.Array:
        parts = [verdicts(part.column("t"), shared.value) for part in pieces([pa.RecordBatch.from_arrays([texts], ["t"])], "t")]
        return pa.concat_arrays(parts) if parts else verdicts(texts, shared.value)

    return docs.withColumn(out_col, look(F.col(text_col)))
