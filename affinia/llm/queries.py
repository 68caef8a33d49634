"""One query per operator over its whole table, and the SQL that checks it where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinia.llm import centroids, decontaminate, fim, html, langid, licenses, line_dedup, near_text, near_vectors, packing, quality_rules, substring_dedup, warc
from affinia.session import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name."""

    def register(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return function(spark, sf_dir)

        run.__name__, run.__doc__ = function.__name__, function.__doc__
        QUERIES[function.__name__] = run
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


def prepare(spark: SparkSession) -> None:
    """Settings that the operators rely on."""
    ensure_checkpoint_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query()
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the share of the item that their tiles cover."""
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("spans")


OP2_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), firsts AS (
  SELECT k, min(doc_id) AS first_id FROM keyed WHERE length(k) >= 10 GROUP BY k
), marked AS (
  SELECT keyed.doc_id, pos, line, coalesce(keyed.doc_id > first_id, false) AS gone
  FROM keyed LEFT JOIN firsts ON keyed.k = firsts.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query(OP2_SQL)
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its lines, how many are dropped, and the digest of what stays."""
    kept = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return kept.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), digest.alias("kept_sha256"))


@query()
def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


@query()
def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector under cosine 0.95."""
    return near_vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
         ELSE list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) END AS s
  FROM words
), classes AS MATERIALIZED (
  SELECT min(doc_id) AS a, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s
), tokens AS MATERIALIZED (
  SELECT a, n, unnest(s) AS t FROM classes
), links AS MATERIALIZED (
  SELECT x.a, y.a AS b FROM tokens x JOIN tokens y ON x.t = y.t AND x.a < y.a
  GROUP BY x.a, y.a, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), edges AS MATERIALIZED (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT a AS node, a AS root FROM classes
  UNION
  SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node
), named AS (
  SELECT node, min(root) AS component_id FROM reach GROUP BY node
)
SELECT sets.doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(named.component_id, sets.doc_id) AS component_id,
       coalesce(named.component_id, sets.doc_id) = sets.doc_id AS kept
FROM sets LEFT JOIN classes ON sets.s = classes.s LEFT JOIN named ON named.node = classes.a
"""


@query(OP5_SQL)
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under similarity 0.8 of its 2-word shingles."""
    return near_text.near_duplicates(table(spark, sf_dir, "documents"), width=2)


OP6_SQL = """
WITH rows AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), digests AS (
  SELECT page_id, octet_length(body) AS n, upper(sha1(body)) AS hex FROM rows
), bits AS (
  SELECT page_id, n, hex, max(page_id) OVER (PARTITION BY hex, n) AS last_id,
         list_aggregate(list_transform(range(40), lambda i: lpad(bin(instr('0123456789ABCDEF', substr(hex, CAST(i + 1 AS BIGINT), 1)) - 1), 4, '0')), 'string_agg', '') AS b
  FROM digests
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(list_sum(list_transform(range(5), lambda j: CAST(substr(b, CAST(5 * i + j + 1 AS BIGINT), 1) AS INTEGER) * CAST(2 ** (4 - j) AS INTEGER))) + 1 AS BIGINT), 1)),
         'string_agg', '') AS payload_digest,
       CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last_id THEN NULL ELSE last_id END AS refers_to
FROM bits
"""


@query(OP6_SQL)
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as the archives that were written give it back."""
    return warc.page_round_trip(table(spark, sf_dir, "pages"))


@query()
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identify(docs)
    return found.select("doc_id", langid.held_out("doc_id").alias("held_out"), "_language.lang_pred", "_language.score")


OP8_SQL = """
WITH words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), windows AS MATERIALIZED (
  SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 13], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(0, len(w) - 12)) AS i FROM words WHERE len(w) >= 13)
), firsts AS (
  SELECT h, min(doc_id) AS first_id FROM windows GROUP BY h HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT windows.doc_id, unnest(range(i, i + 13)) AS i
  FROM windows JOIN firsts USING (h) WHERE windows.doc_id > first_id
), each AS (
  SELECT words.doc_id, len(w) AS n, unnest(CASE WHEN len(w) = 0 THEN [NULL] ELSE w END) AS word,
         unnest(CASE WHEN len(w) = 0 THEN [0] ELSE range(0, len(w)) END) AS i
  FROM words
)
SELECT each.doc_id, any_value(n) AS n_words, count(gone.i) AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY each.i) FILTER (gone.i IS NULL), '')) AS kept_sha256
FROM each LEFT JOIN gone ON gone.doc_id = each.doc_id AND gone.i = each.i
GROUP BY each.doc_id
"""


@query(OP8_SQL)
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its words, how many lie in a repeat of 13 words, and the digest of the others."""
    counts, changed = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    less = changed.select(
        F.col("_id").alias("_cid"), F.col("_row").alias("_crow"), "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("_sha")
    ).distinct()
    same = (F.col("_id") == F.col("_cid")) & (F.col("_row") == F.col("_crow"))
    return counts.join(less, same, "left").select(
        F.col("_id").alias("doc_id"), "n_words", F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("_sha", "sha256").alias("kept_sha256"),
    )


@query()
def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract(table(spark, sf_dir, "pages"))


@query()
def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and template spans of every document."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def _rounds(n: int) -> str:
    """The relations near0, cent1, ..., near<n> after cent0."""
    out = []
    for r in range(n + 1):
        out.append(f"""sums{r} AS (
  SELECT vec_id, m, sum((kept.x - c.x) * (kept.x - c.x)) AS d FROM kept JOIN cent{r} c USING (i) GROUP BY vec_id, m
), near{r} AS MATERIALIZED (
  SELECT vec_id, arg_min(m, (d, m)) AS m, min(d) AS d FROM sums{r} GROUP BY vec_id
)""")
        if r < n:
            out.append(f"""means{r} AS (
  SELECT near{r}.m, i, sum(x) AS s, count(*) AS n FROM near{r} JOIN kept USING (vec_id) GROUP BY near{r}.m, i
), cent{r + 1} AS MATERIALIZED (
  SELECT m, i, CASE WHEN n IS NULL THEN x ELSE (s - (s % n + n) % n) // n END AS x FROM cent{r} LEFT JOIN means{r} USING (m, i)
)""")
    return ", ".join(out)


OP11_SQL = f"""
WITH usable AS (
  SELECT vec_id, embedding AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), kept AS MATERIALIZED (
  SELECT vec_id, i, CAST(floor(64 * CAST(e[i] AS DOUBLE)) AS HUGEINT) AS x FROM usable, range(1, 65) AS r(i)
), drawn AS (
  SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS m FROM usable
), cent0 AS MATERIALIZED (
  SELECT m, i, x FROM drawn JOIN kept USING (vec_id) WHERE m < 16
), {_rounds(3)}, texts AS (
  SELECT m, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM cent3 GROUP BY m
)
SELECT vec_id, CAST(m AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY m) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM near3 JOIN texts USING (m)
"""


@query(OP11_SQL)
def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, distance and inertia of every vector after three rounds with 16 centroids."""
    return centroids.cluster(table(spark, sf_dir, "embeddings"))[0]


def _term(p: str, q: str) -> str:
    """Term of the Jensen-Shannon divergence."""
    one = "(CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({x} + {y})) ELSE 0 END)"
    return f"(({one.format(x=p, y=q)} + {one.format(x=q, y=p)}) / 2)"


def _judged(n: int, good: str) -> str:
    """The relations of the references from the documents in `good`, and best<n>: every document's distances."""
    return f"""refclass{n} AS MATERIALIZED (
  SELECT lang, c, sum(v) / sum(sum(v)) OVER (PARTITION BY lang) AS q FROM classes JOIN {good} USING (doc_id) JOIN named USING (lang) GROUP BY lang, c
), refsize{n} AS (
  SELECT lang, sum(n_tokens) AS n FROM measured JOIN {good} USING (doc_id) GROUP BY lang
), refword{n} AS MATERIALIZED (
  SELECT t.lang, t.word, sum(t.n) / any_value(refsize{n}.n) AS q
  FROM tok t JOIN {good} USING (doc_id) JOIN common USING (lang, word) JOIN refsize{n} USING (lang) GROUP BY t.lang, t.word
), refrest{n} AS (
  SELECT lang, coalesce(sum(q), 0) AS s FROM (SELECT DISTINCT lang FROM refclass{n}) LEFT JOIN refword{n} USING (lang) GROUP BY lang
), byclass{n} AS (
  SELECT doc_id, r.lang, sum({_term('p', 'q')}) AS d
  FROM (SELECT doc_id, c, v / greatest(n_chars, 1) AS p FROM classes JOIN measured USING (doc_id)) x JOIN refclass{n} r USING (c) GROUP BY doc_id, r.lang
), hits{n} AS (
  SELECT doc_id, r.lang, sum({_term('(t.n / n_tokens)', 'q')}) AS d, sum(q) AS q, sum(t.n / n_tokens) AS p
  FROM tok t JOIN measured USING (doc_id) JOIN refword{n} r USING (word) GROUP BY doc_id, r.lang
), both{n} AS (
  SELECT b.doc_id, b.lang, CASE WHEN n_chars >= {quality_rules.MIN_CHARS} THEN b.d END AS dc,
         CASE WHEN n_tokens >= {quality_rules.MIN_WORDS} THEN coalesce(h.d, 0) + greatest(s - coalesce(h.q, 0), 0) / 2
              + {_term('(1 - coalesce(h.p, 0))', '(1 - s)')} END AS dw
  FROM byclass{n} b JOIN measured USING (doc_id) JOIN refrest{n} r ON r.lang = b.lang LEFT JOIN hits{n} h ON h.doc_id = b.doc_id AND h.lang = b.lang
), best{n} AS MATERIALIZED (
  SELECT doc_id, lang, sqrt(CASE WHEN dc < 0 THEN 0 ELSE dc END) AS dc, sqrt(CASE WHEN dw < 0 THEN 0 ELSE dw END) AS dw
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(dc, 0) + coalesce(dw, 0), lang) AS k FROM both{n}) WHERE k = 1
)"""


_CLASSES = {0: "a-z", 1: "A-Z", 2: "0-9", 3: "\\x20\\x09-\\x0D", 4: ".,;:!?'\"()\\-", 5: "#*$%&|<>", 7: "\\x{80}-\\x{24F}", 8: "\\x{250}-\\x{10FFFF}"}
_CLASS_COUNTS = ", ".join(f"length(regexp_replace(t, '[^{c.replace(chr(39), chr(39) * 2)}]', '', 'g')) AS c{k}" for k, c in _CLASSES.items())
_SUM = " - ".join(f"c{k}" for k in _CLASSES)
_UNPIVOT = " UNION ALL ".join(f"SELECT doc_id, lang, {k} AS c, c{k} AS v FROM counted" for k in _CLASSES)

OP12_SQL = f"""
WITH texts AS MATERIALIZED (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS lang FROM documents
), counted AS MATERIALIZED (
  SELECT doc_id, lang, length(t) AS n_chars, {_CLASS_COUNTS} FROM texts
), classes AS MATERIALIZED (
  {_UNPIVOT} UNION ALL SELECT doc_id, lang, 6 AS c, n_chars - {_SUM} AS v FROM counted
), words AS MATERIALIZED (
  SELECT doc_id, lang, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
         regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS tokens,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM texts
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 5], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(0, len(w) - 4)) AS i FROM words WHERE len(w) >= 5)
), inside AS (
  SELECT doc_id, count(DISTINCT i + j) AS n
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS same FROM windows), range(0, 5) AS r(j) WHERE same > 1 GROUP BY doc_id
), measured AS MATERIALIZED (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed
  FROM (
    SELECT words.doc_id, words.lang, n_chars, CAST(len(tokens) AS BIGINT) AS n_tokens, CAST(len(w) AS BIGINT) AS n_words,
           length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars, c5 AS n_symbols,
           CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(inside.n, 0) AS n_repeat_words
    FROM words JOIN counted USING (doc_id) LEFT JOIN inside ON inside.doc_id = words.doc_id
  )
), tok AS MATERIALIZED (
  SELECT doc_id, lang, word, count(*) AS n FROM (SELECT doc_id, lang, unnest(tokens) AS word FROM words) GROUP BY doc_id, lang, word
), sizes AS (
  SELECT lang, sum(n_tokens) AS n FROM measured GROUP BY lang
), named AS MATERIALIZED (
  SELECT lang, n AS lang_n FROM sizes WHERE lang <> '' AND n >= {quality_rules.LANGUAGE_SHARE} * (SELECT sum(n) FROM sizes)
), common AS MATERIALIZED (
  SELECT lang, word FROM tok JOIN named USING (lang) GROUP BY lang, word, lang_n HAVING sum(n) >= {quality_rules.COMMON} * lang_n
), good1 AS MATERIALIZED (
  SELECT doc_id FROM measured JOIN named USING (lang)
  WHERE NOT base_failed AND n_chars >= {quality_rules.MIN_CHARS} AND n_tokens >= {quality_rules.MIN_WORDS}
), {_judged(1, 'good1')}, good2 AS MATERIALIZED (
  SELECT doc_id FROM good1 JOIN best1 USING (doc_id) WHERE dc <= {quality_rules.MAX_CHAR_DISTANCE} AND dw <= {quality_rules.MAX_WORD_DISTANCE}
), {_judged(2, 'good2')}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(dc > {quality_rules.MAX_CHAR_DISTANCE}, false) AND NOT coalesce(dw > {quality_rules.MAX_WORD_DISTANCE}, false) AS kept,
       CASE WHEN dc IS NOT NULL OR dw IS NOT NULL THEN best2.lang END AS reference,
       floor(dc * 1e6 + 0.5) / 1e6 AS char_distance, floor(dw * 1e6 + 0.5) / 1e6 AS word_distance
FROM measured LEFT JOIN best2 USING (doc_id)
"""


@query(OP12_SQL)
def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures, distances from the language references and verdict of every document."""
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), out_col="_quality")
    six = [(F.floor(F.col(f"_quality.{c}") * 1e6 + 0.5) / 1e6).alias(c) for c in ("char_distance", "word_distance")]
    plain = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "reference")
    return judged.select("doc_id", *(f"_quality.{c}" for c in plain), *six)


OP13_SQL = """
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS hex FROM documents
), drawn AS (
  SELECT *, CAST('0x' || hex[1:8] AS BIGINT) % (n + 1) AS x, CAST('0x' || hex[9:16] AS BIGINT) % (n + 1) AS y,
         CAST('0x' || hex[17:24] AS BIGINT) % 100 AS h3, CAST('0x' || hex[25:32] AS BIGINT) % 100 AS h4
  FROM hashed
), formed AS (
  SELECT *, least(x, y) AS a, greatest(x, y) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain'
              WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), cut AS (
  SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1, n - b) AS s FROM formed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM cut
"""


@query(OP13_SQL)
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, cuts, and digests of the output and of the text restored from it, of every document."""
    turned = fim.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = fim.restored(F.col("_fim.output"), F.col("_fim.form"))
    digest = [F.sha2(c.cast("binary"), 256).alias(name) for c, name in ((F.col("_fim.output"), "output_sha256"), (back, "restored_sha256"))]
    return turned.select("doc_id", *(f"_fim.{c}" for c in ("n", "form", "prefix_chars", "middle_chars")), *digest)
