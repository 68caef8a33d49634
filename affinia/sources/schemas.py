"""Declared schemas of the JSONL and CSV inputs."""

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


STR, INT, DBL = T.StringType(), T.IntegerType(), T.DoubleType()

# Compliment counters of a user record, as fixed by the input format.
COMPLIMENTS = [
    "hot", "more", "profile", "cute", "list", "note", "plain", "cool", "funny", "writer", "photos",
]

USERS = _struct(
    user_id=STR, average_stars=DBL, review_count=INT, fans=INT, useful=INT, funny=INT, cool=INT,
    yelping_since=STR, friends=STR, elite=STR, **{f"compliment_{c}": INT for c in COMPLIMENTS},
)
BUSINESSES = _struct(
    business_id=STR, stars=DBL, review_count=INT, categories=STR, city=STR, is_open=INT,
    latitude=DBL, longitude=DBL,
)
REVIEWS = _struct(
    review_id=STR, user_id=STR, business_id=STR, stars=DBL, date=STR, useful=INT, funny=INT,
    cool=INT, text=STR,
)
TIPS = _struct(user_id=STR, business_id=STR)
PHOTOS = _struct(photo_id=STR, business_id=STR, label=STR)
PAIRS = _struct(user_id=STR, business_id=STR, stars=DBL)
PREDICTIONS = _struct(user_id=STR, business_id=STR, prediction=DBL)
SETTINGS = _struct(rank=DBL, reg=DBL, alpha=DBL, rmse=DBL)
RECOMMENDED = _struct(user_id=STR, business_id=STR, score=DBL, rank=INT)
SIMILAR_PAIRS = _struct(business_id_1=STR, business_id_2=STR, similarity=DBL)
