"""Feature transforms."""

from pyspark.sql import functions as F

from affinia.functions.scalars import photo_path, rounded
from affinia.functions.vectors import is_zero, norm
from affinia.operators import blocks as B
from affinia.operators import transforms as X
from affinia.plans.aggregations import DIM, EDGES
from affinia.plans.factorization import VECTORS, business_vectors
from affinia.plans.projections import WORDS
from affinia.plans.registry import query, r
from affinia.session import materialise

SCALED = ["review_count", "useful", "funny", "cool", "fans", "average_stars"]


@query("standard_scale", "SELECT user_id, " + ", ".join(
    r(f"({c} - (SELECT avg({c}) FROM users)) / (SELECT stddev_pop({c}) FROM users)") + f" AS {c}" for c in SCALED) + " FROM users")
def standard_scale(t):
    users = materialise(t.users.select("user_id", *SCALED), "users")
    return X.standard_scale(users, SCALED).withColumns({c: rounded(c) for c in SCALED})


@query("multi_hot_categories", "SELECT DISTINCT business_id, category, CAST(1 AS INT) AS value FROM cat_edges WHERE category <> ''", EDGES)
def multi_hot_categories(t):
    return X.multi_hot(t.places)


NUMBERS = ["stars", "review_count", "latitude", "longitude"]
_SCALED = " UNION ALL ".join(
    f"SELECT business_id, {i} AS pos, coalesce(({c} - (SELECT avg({c}) FROM businesses)) / nullif((SELECT stddev_pop({c}) FROM businesses), 0), 0) AS value FROM businesses"
    for i, c in enumerate(NUMBERS)
)
# The documents are dealt to the businesses by number, as their texts.
IDF = f"""text_words AS (SELECT 'b' || CAST(doc_id % (SELECT count(*) FROM supplier) + 1 AS VARCHAR) AS business_id, unnest({WORDS}) AS w
  FROM documents WHERE text IS NOT NULL),
word_counts AS (SELECT business_id, w, count(*) AS n FROM text_words GROUP BY business_id, w),
having_word AS (SELECT w, count(*) AS having_w FROM word_counts GROUP BY w),
weighted AS (SELECT business_id, w, n * (1 + ln(((SELECT count(DISTINCT business_id) FROM word_counts) + 1) / (having_w + 1))) AS weight
  FROM word_counts JOIN having_word USING (w)),
text_cells AS (SELECT business_id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {DIM} AS pos, sum(weight) AS x FROM weighted GROUP BY ALL),
text_part AS (SELECT business_id, pos, x / sqrt(sum(x * x) OVER (PARTITION BY business_id)) AS value FROM text_cells)"""
BLOCKS = f"""{EDGES}, {VECTORS}, {IDF},
cat_names AS (SELECT category, row_number() OVER (ORDER BY category) - 1 AS pos FROM (SELECT DISTINCT category FROM cat_edges WHERE category <> '')),
block_layout AS (SELECT 'numbers' AS part, 0 AS place, {len(NUMBERS)} AS width UNION ALL SELECT 'categories', {len(NUMBERS)}, (SELECT count(*) FROM cat_names)
  UNION ALL SELECT 'text', {len(NUMBERS)} + (SELECT count(*) FROM cat_names), {DIM}
  UNION ALL SELECT 'photo', {len(NUMBERS) + DIM} + (SELECT count(*) FROM cat_names), {DIM}),
block_parts AS (SELECT business_id, 'numbers' AS part, pos, CAST(value AS DOUBLE) AS value FROM ({_SCALED})
  UNION ALL SELECT DISTINCT business_id, 'categories', pos, 1e0 FROM cat_edges JOIN cat_names USING (category)
  UNION ALL SELECT business_id, 'text', pos, value FROM text_part
  UNION ALL SELECT business_id, 'photo', generate_subscripts(bv, 1) - 1, unnest(bv) FROM biz_vec),
block_entries AS (SELECT business_id, part, place + pos AS pos, {r('value', 5)} AS value FROM block_parts JOIN block_layout USING (part))"""


def business_blocks(t):
    return B.business_blocks(t.places, lambda: t.shared().businesses, lambda: t.texts, lambda: business_vectors(t), DIM)


@query("assemble_features", "SELECT business_id, CAST(pos AS BIGINT) AS pos, value FROM block_entries WHERE value <> 0", BLOCKS)
def assemble_features(t):
    """Entries of every business's vector: scaled numbers, categories, words and photos."""
    return business_blocks(t).placed().withColumn("value", rounded("value", 5)).where("value <> 0")


@query("feature_layout", 'SELECT part, CAST(place AS BIGINT) AS "offset", CAST(width AS BIGINT) AS width FROM block_layout', BLOCKS)
def feature_layout(t):
    """Where each part lies in these vectors."""
    return business_blocks(t).layout_table()


@query("text_idf", f"SELECT business_id, w AS word, {r('weight', 5)} AS weight FROM weighted", IDF)
def text_idf(t):
    """Words of every business's texts with inverse document weights."""
    return B.idf_counts(t.texts, "business_id", "text").withColumn("weight", rounded("weight", 5))


VISITS = """visits AS (SELECT user_id, city, count(*) AS visits FROM (SELECT DISTINCT user_id, business_id FROM reviews)
  JOIN businesses USING (business_id) WHERE city <> '' GROUP BY user_id, city)"""


def visits(t):
    return X.city_matrix(t.reviews, t.places)


@query("city_matrix", "SELECT * FROM visits", VISITS)
def city_matrix(t):
    return visits(t)


def _squared(name: str, of: str, d: int) -> str:
    """The square of a symmetric matrix (a list of d * d numbers), scaled to a largest entry of 1."""
    product = f"list_transform(range({d * d}), lambda p: list_sum(list_transform(range({d}), lambda q: m[(p // {d}) * {d} + q + 1] * m[q * {d} + p % {d} + 1])))"
    return f"""{name} AS (SELECT list_transform(m, lambda v: v / list_max(list_transform(m, lambda w: abs(w)))) AS m
  FROM (SELECT {product} AS m FROM {of}))"""


def _axis(number: int, of: str, d: int, rounds: int = 36) -> str:
    """Relation axis<number>(v, l): unit eigenvector with a positive largest entry, and eigenvalue, of the matrix in `of`,
    whose powers tend to the projection on it."""
    steps = [_squared(f"power{number}_{i}", f"power{number}_{i - 1}" if i else of, d) for i in range(rounds)]
    column = f"list_transform(range({d}), lambda p: m[p * {d} + big + 1])"
    scaled = f"list_transform(c, lambda v: v / sqrt(list_dot_product(c, c)) * sign(list_max(c) + list_min(c)))"
    value = f"list_sum(list_transform(range({d * d}), lambda p: u.v[p // {d} + 1] * o.m[p + 1] * u.v[p % {d} + 1]))"
    return f"""{', '.join(steps)},
peak{number} AS (SELECT m, list_position(diagonal, list_max(diagonal)) - 1 AS big FROM (
  SELECT m, list_transform(range({d}), lambda p: m[p * {d} + p + 1]) AS diagonal FROM power{number}_{rounds - 1})),
axis{number} AS (SELECT u.v, {value} AS l FROM (SELECT {scaled} AS v FROM (SELECT {column} AS c FROM peak{number})) u, {of} o)"""


_D = len(SCALED)
_COVARIANCE = ", ".join(f"covar_pop(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for a in SCALED for b in SCALED)
AXES = f"""matrix1 AS (SELECT [{_COVARIANCE}] AS m FROM users), {_axis(1, 'matrix1', _D)},
matrix2 AS (SELECT list_transform(range({_D * _D}), lambda p: o.m[p + 1] - a.l * a.v[p // {_D} + 1] * a.v[p % {_D} + 1]) AS m FROM matrix1 o, axis1 a),
{_axis(2, 'matrix2', _D)}, axes AS (SELECT 0 AS component, v FROM axis1 UNION ALL SELECT 1, v FROM axis2)"""
_CENTRED = ", ".join(f"{c} - (SELECT avg({c}) FROM users)" for c in SCALED)


@query("pca_2d", f"""SELECT user_id, CAST(component AS INT) AS component, {r('list_dot_product(x, v)', 4)} AS value
  FROM (SELECT user_id, [{_CENTRED}] AS x FROM users), axes""", AXES)
def pca_2d(t):
    users = materialise(t.users.select("user_id", *SCALED), "users")
    scores = X.pca(users, "user_id", SCALED).select("user_id", F.posexplode("components").alias("component", "value"))
    return scores.withColumn("value", rounded("value", 4))


BAG = f"""words AS (SELECT doc_id, unnest({WORDS}) AS w FROM documents WHERE text IS NOT NULL),
bag AS (SELECT doc_id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {DIM} AS pos, count(*) AS n FROM words GROUP BY ALL)"""


@query("text_embed", f"""SELECT doc_id, CAST(pos AS INT) AS pos, {r('n / sqrt(sum(n * n) OVER (PARTITION BY doc_id))')} AS value FROM bag""", BAG)
def text_embed(t):
    """Non-zero entries of each document's vector, from the whole text."""
    docs = t.table("documents").dropna(subset=["text"]).select("doc_id", "text")
    vectors = X.embed_text(docs, "doc_id", "text", DIM)
    return vectors.select("doc_id", F.posexplode("embedding").alias("pos", "value")).where("value <> 0").withColumn(
        "value", rounded("value")
    )


@query("image_embed_table", f"""SELECT photo_id, business_id, 'photos/' || photo_id || '.jpg' AS path,
  len(embedding) AS dims, {r('sqrt(list_dot_product(embedding, embedding))', 5)} AS length FROM photos""")
def image_embed_table(t):
    # a zero vector stands for a photo that was not encoded, so the vector table does not list it
    encoded = t.photos.where(~is_zero("embedding")).select("photo_id", "embedding")
    return X.image_table(t.photos.drop("embedding"), encoded, DIM).select(
        "photo_id", "business_id", photo_path("photo_id").alias("path"),
        F.size("embedding").cast("bigint").alias("dims"), rounded(norm("embedding"), 5).alias("length"),
    )


@query("class_weights", f"""SELECT quality, count(*) AS n, {r('(SELECT count(*) FROM labels) / ((SELECT count(DISTINCT quality) FROM labels) * count(*))')} AS weight
  FROM labels GROUP BY quality""", plain=True)
def class_weights(t):
    return X.class_weights(t.table("labels"), "quality").withColumn("weight", rounded("weight"))
