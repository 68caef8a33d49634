"""Set and vector similarity."""

import math

from pyspark.sql import functions as F

from affinia.functions.scalars import rounded
from affinia.operators import similarity as L
from affinia.operators.interactions import index_ids
from affinia.operators.topk import embedding_top_k as embedding_top_k_of
from affinia.plans.factorization import VECTORS, business_vectors, user_vectors
from affinia.plans.joins import EDGES, minhash_sql
from affinia.plans.registry import h32, query, r
from affinia.session import materialise

# The fixture's largest Jaccard is 0.2; the job's own 0.5 is used by the unit tests.
THRESHOLD = 0.17
LAYOUT = L.Layout.solve(THRESHOLD)


def edges(t):
    return L.user_sets(t.counts, index_ids(t.counts, "user_id"))


# Businesses by user set; equal sets share the smallest id.
GROUPS = """set_lists AS (SELECT business_id, count(*) AS n, list(user_idx ORDER BY user_idx) AS users FROM edges GROUP BY business_id),
groups AS (SELECT *, min(business_id) OVER (PARTITION BY users) AS rep FROM set_lists),
reps AS (SELECT * FROM groups WHERE business_id = rep),
copies AS (SELECT rep AS business_id_1, business_id AS business_id_2, 1e0 AS similarity FROM groups WHERE business_id <> rep),
common AS (SELECT a.business_id AS business_id_1, b.business_id AS business_id_2, count(*) AS c
  FROM edges a JOIN edges b ON a.user_idx = b.user_idx AND a.business_id < b.business_id
  WHERE a.business_id IN (SELECT rep FROM reps) AND b.business_id IN (SELECT rep FROM reps) GROUP BY ALL),
jac AS (SELECT c.business_id_1, c.business_id_2, c.c / (x.n + y.n - c.c) AS similarity FROM common c
  JOIN reps x ON x.business_id = business_id_1 JOIN reps y ON y.business_id = business_id_2)"""


def sketch_sql() -> str:
    """(business_id, number, value): the registers, empty ones filled from the first filled one in an order of their own."""
    a, b, c, d = L.sketch_params()
    k, p, q = LAYOUT.registers, L.MODULUS, L.SECOND_MODULUS
    orders = ", ".join(f"({i}, {x}, {y})" for i, (x, y) in enumerate(L.fill_params(k)))
    return f"""fill_order(number, e, f) AS (VALUES {orders}),
hashed AS (SELECT business_id, ((CAST({a} AS BIGINT) * user_idx + {b}) % {p} * {c} + {d}) % {q} AS h FROM edges),
filled AS (SELECT business_id, h % {k} AS number, min(h) // {k} AS value FROM hashed GROUP BY business_id, h % {k}),
empty AS (SELECT business_id, number FROM (SELECT DISTINCT business_id FROM filled) CROSS JOIN range({k}) AS r(number)
  EXCEPT SELECT business_id, number FROM filled),
registers AS (SELECT business_id, number, value FROM filled UNION ALL
  SELECT x.business_id, x.number, arg_min(y.value, (CAST(e AS BIGINT) * y.number + f) % {p})
  FROM empty x JOIN filled y ON x.business_id = y.business_id JOIN fill_order o ON o.number = x.number GROUP BY x.business_id, x.number)"""


_UNION = f"((x.n + y.n) / {1.0 + THRESHOLD!r})"
_INDEPENDENT = f"({float(LAYOUT.registers)!r} * {_UNION} / ({float(LAYOUT.registers)!r} + {_UNION}))"
_LEAST = f"{THRESHOLD!r} - {L.DEVIATIONS * math.sqrt(THRESHOLD * (1 - THRESHOLD))!r} / sqrt({_INDEPENDENT})"
BANDS = f"""{EDGES}, {sketch_sql()},
bands AS (SELECT business_id, number // {LAYOUT.rows} AS band, list(value ORDER BY number) AS key FROM registers
  WHERE number < {LAYOUT.rows * LAYOUT.bands} GROUP BY business_id, number // {LAYOUT.rows})"""
CANDIDATES = f"""banded AS (SELECT DISTINCT a.business_id AS business_id_1, b.business_id AS business_id_2
  FROM bands a JOIN bands b ON a.band = b.band AND a.key = b.key AND a.business_id < b.business_id
  WHERE a.business_id IN (SELECT rep FROM reps) AND b.business_id IN (SELECT rep FROM reps)),
agreeing AS (SELECT business_id_1, business_id_2, count(*) FILTER (v.value % 256 = w.value % 256) AS agree
  FROM banded JOIN registers v ON v.business_id = business_id_1 JOIN registers w ON w.business_id = business_id_2 AND w.number = v.number
  GROUP BY business_id_1, business_id_2),
candidates AS (SELECT business_id_1, business_id_2 FROM agreeing JOIN reps x ON x.business_id = business_id_1 JOIN reps y ON y.business_id = business_id_2
  WHERE least(x.n, y.n) >= {THRESHOLD} * greatest(x.n, y.n) AND agree >= {float(LAYOUT.registers)!r} * (({_LEAST}) * 255e0 + 1e0) / 256e0)"""


@query("business_user_sets", "SELECT business_id, user_idx FROM edges", EDGES)
def business_user_sets(t):
    return edges(t)


@query("minhash_signature", "SELECT business_id, CAST(h AS INT) AS h, v FROM sig", f"{EDGES}, {minhash_sql()}")
def minhash_signature(t):
    return L.minhash(edges(t), L.hash_params()).select("business_id", F.posexplode("signature").alias("h", "v"))


@query("lsh_candidates", "SELECT * FROM candidates", f"{BANDS}, {GROUPS}, {CANDIDATES}")
def lsh_candidates(t):
    sets = materialise(edges(t), "edges")
    reps = L.set_groups(sets).where("business_id = representative").select("business_id", "size")
    sketches = L.register_sketch(sets, LAYOUT.registers).join(reps, "business_id")
    return L.lsh_candidates(materialise(sketches, "sketches"), LAYOUT)


@query("jaccard_verify", f"SELECT business_id_1, business_id_2, {r('similarity')} AS similarity FROM jac JOIN candidates USING (business_id_1, business_id_2) WHERE similarity >= {THRESHOLD}",
       f"{BANDS}, {GROUPS}, {CANDIDATES}")
def jaccard_verify(t):
    found = L.jaccard(lsh_candidates(t), edges(t), THRESHOLD)
    return found.withColumn("similarity", rounded("similarity"))


@query("similar_businesses", f"""SELECT business_id_1, business_id_2, {r('similarity')} AS similarity FROM (
  SELECT * FROM jac JOIN candidates USING (business_id_1, business_id_2) WHERE similarity >= {THRESHOLD} UNION ALL SELECT * FROM copies)""",
       f"{BANDS}, {GROUPS}, {CANDIDATES}")
def similar_businesses(t):
    found = L.similar_businesses(edges(t), THRESHOLD).withColumn("similarity", rounded("similarity"))
    return found.orderBy("business_id_1", "business_id_2")


@query("jaccard_exact", f"""SELECT business_id_1, business_id_2, {r('similarity')} AS similarity FROM (
  SELECT * FROM jac WHERE similarity >= {THRESHOLD} UNION ALL SELECT * FROM copies)""", f"{EDGES}, {GROUPS}")
def jaccard_exact(t):
    return L.jaccard_all(edges(t), THRESHOLD).withColumn("similarity", rounded("similarity"))


COSINE = "list_dot_product({0}, {1}) / sqrt(list_dot_product({0}, {0}) * list_dot_product({1}, {1}))"


@query("cosine_matrix", f"""SELECT x.photo_id AS a, y.photo_id AS b, {r(COSINE.format('x.embedding', 'y.embedding'), 5)} AS similarity
  FROM sampled x CROSS JOIN sampled y""", f"sampled AS (SELECT * FROM photos ORDER BY {h32('42', 'photo_id')}, photo_id LIMIT 20)")
def cosine_matrix(t):
    return L.cosine_matrix(t.photos, "photo_id", "embedding", 20).withColumn("similarity", rounded("similarity", 5))


@query("cosine_by_category", f"""SELECT x.label AS label_a, y.label AS label_b, count(*) AS n_pairs,
  {r(f"avg({COSINE.format('x.embedding', 'y.embedding')})", 5)} AS mean_similarity
  FROM photos x JOIN photos y ON x.photo_id <> y.photo_id GROUP BY x.label, y.label""")
def cosine_by_category(t):
    means = L.cosine_by_label(t.photos, "label", "embedding")
    return means.withColumn("mean_similarity", rounded("mean_similarity", 5))


TOP = f"""scores AS (SELECT u.user_id, b.business_id, {r(COSINE.format('u.uv', 'b.bv'))} AS score FROM user_vec u CROSS JOIN biz_vec b),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, business_id) AS INT) AS rank FROM scores)"""


def top_10(t):
    found = embedding_top_k_of(user_vectors(t), business_vectors(t), "user_id", "business_id", "features", k=10)
    return found.withColumnsRenamed({"query_id": "user_id", "item_id": "business_id"})


@query("embedding_top_k", f"SELECT user_id, business_id, {r('score', 5)} AS score, rank FROM ranked WHERE rank <= 10", f"{VECTORS}, {TOP}")
def embedding_top_k(t):
    return top_10(t).withColumn("score", rounded("score", 5))


@query("l2_normalize", f"""SELECT photo_id, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS pos,
  {r('unnest(embedding) / sqrt(list_dot_product(embedding, embedding))')} AS value FROM photos""")
def l2_normalize(t):
    return L.normalized(t.photos, "photo_id", "embedding")
