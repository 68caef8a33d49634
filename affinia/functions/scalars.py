"""Scalar expressions: profiles, log scales, categories, buckets, distances."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the rating model.
REFERENCE_YEAR = 2024
REVIEW_AS_OF = "2024-01-01"
MAX_INTERACTIONS = 284
AFFINITY_FACTOR = 50
EARTH_RADIUS_KM = 6371
STAR_LABELS = ["1-Star", "2-Star", "3-Star", "4-Star", "5-Star"]
STAR_EDGES = [0.0, 1.5, 2.5, 3.5, 4.5, 5.5]


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def rounded(col: Column | str, digits: int = 6) -> Column:
    """Round half up through floor, the same on every SQL engine."""
    scale = float(10**digits)
    return F.floor(_c(col) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


# --- users -----------------------------------------------------------------


def interaction_total(*cols: str) -> Column:
    """Sum of the feedback counters; a missing counter counts 0."""
    return reduce(add, [F.coalesce(_c(c), F.lit(0)) for c in cols])


def account_age(col: Column | str, ref_year: int = REFERENCE_YEAR) -> Column:
    """Years between the year of a `yyyy-MM-dd` string and `ref_year`."""
    since = F.coalesce(_c(col), F.lit(str(ref_year)))
    return F.lit(ref_year) - F.substring_index(since, "-", 1).cast("int")


def csv_len(col: Column | str) -> Column:
    """Entries of a comma list; the literal 'None' holds none, '' holds one."""
    c = _c(col)
    return F.when(c == "None", F.lit(0)).otherwise(F.size(F.split(c, ",")))


def sum_prefix(df: DataFrame, prefix: str) -> Column:
    """Sum of every column whose name starts with `prefix`."""
    names = [c for c in df.columns if c.startswith(prefix)]
    return reduce(add, [F.col(c) for c in names]) if names else F.lit(0)


# --- reviews ---------------------------------------------------------------


def parsed_date(col: Column | str) -> Column:
    """`yyyy-MM-dd` to date; anything else gives null instead of an error."""
    return F.try_to_date(_c(col), "yyyy-MM-dd")


def years_online(col: Column | str, as_of: str = REVIEW_AS_OF) -> Column:
    """Years from the review date to `as_of`, at least one; no date means `as_of`."""
    date = parsed_date(F.coalesce(_c(col), F.lit(REVIEW_AS_OF)))
    days = F.datediff(F.to_date(F.lit(as_of)), date)
    # greatest() skips nulls; an unreadable date has to stay null
    return F.when(date.isNotNull(), F.greatest(days / F.lit(365.0), F.lit(1.0)))


# --- categories and ids ----------------------------------------------------


def clean_categories(col: Column | str) -> Column:
    """Category text to lower-case tokens.

    '&' and '/' turn into blanks, brackets go, and two blanks in a row vanish, so
    'Foo  Bar' gives 'foobar'. Null gives an empty array.
    """
    c = _c(col)
    for char in ("&", "/"):
        c = F.replace(c, F.lit(char), F.lit(" "))
    for gone in ("(", ")", "  "):
        c = F.replace(c, F.lit(gone), F.lit(""))
    tokens = F.transform(F.split(c, ","), lambda t: F.lower(F.trim(t)))
    return F.coalesce(tokens, F.array().cast("array<string>"))


def split_categories(col: Column | str) -> Column:
    """Distinct non-empty parts of a ', ' list, in order of first sight."""
    parts = F.split(F.coalesce(_c(col), F.lit("")), ", ")
    return F.array_remove(F.array_distinct(parts), "")


def with_suffix(col: Column | str, suffix: str) -> Column:
    return F.concat(_c(col), F.lit(suffix))


def without_suffix(col: Column | str, suffix: str) -> Column:
    c = _c(col)
    cut = F.substring(c, F.lit(1), F.length(c) - F.lit(len(suffix)))
    return F.when(c.endswith(suffix), cut).otherwise(c)


def photo_path(col: Column | str, folder: str = "photos") -> Column:
    return F.concat(F.lit(f"{folder}/"), _c(col), F.lit(".jpg"))


def hash32(*cols: Column | str) -> Column:
    """Repeatable 32-bit value of a key: the first eight hex digits of its MD5."""
    text = F.concat_ws("|", *[_c(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


# --- affinity scale --------------------------------------------------------


def log_affinity(col: Column | str, max_n: int | Column = MAX_INTERACTIONS) -> Column:
    """Count 1..max_n to the 1..5 scale, by logarithm."""
    low = F.log(F.lit(2.0))
    high = F.log(F.lit(max_n) + F.lit(1.0))
    return F.lit(1.0) + F.lit(4.0) * (F.log(_c(col) + F.lit(1.0)) - low) / (high - low)


def inverse_log_affinity(col: Column | str, max_n: int | Column = MAX_INTERACTIONS) -> Column:
    """Score on the 1..5 scale back to a count."""
    low = F.log(F.lit(2.0))
    high = F.log(F.lit(max_n) + F.lit(1.0))
    return F.exp((_c(col) - F.lit(1.0)) / F.lit(4.0) * (high - low) + low) - F.lit(1.0)


def magnified_affinity(col: Column | str, k: float = AFFINITY_FACTOR, max_n: int = MAX_INTERACTIONS) -> Column:
    """k times the inverse scale; a pair without score gets 0."""
    return F.coalesce(F.lit(float(k)) * inverse_log_affinity(col, max_n), F.lit(0.0))


def half_precision(col: Column | str) -> Column:
    """Value in [1, 8) rounded to the nearest half-precision float, ties to even."""
    c = _c(col)
    step = F.when(c < 2, F.lit(1024.0)).when(c < 4, F.lit(512.0)).otherwise(F.lit(256.0))
    return F.rint(c * step) / step


# --- predictions -----------------------------------------------------------


def clip(col: Column | str, low: float | None = 1.0, high: float | None = 5.0) -> Column:
    c = _c(col)
    if high is not None:
        c = F.when(c > high, F.lit(float(high))).otherwise(c)
    if low is not None:
        c = F.when(c < low, F.lit(float(low))).otherwise(c)
    return c


def round_stars(col: Column | str, mode: str = "half_even") -> Column:
    """Whole stars: halves to the even neighbour, or up."""
    if mode == "half_even":
        return F.rint(_c(col))
    if mode == "half_up":
        return F.floor(_c(col) + F.lit(0.5)).cast("double")
    raise ValueError(f"unknown rounding mode {mode!r}")


def star_bucket(col: Column | str) -> Column:
    """Label of the half-open star bin; null outside all bins."""
    c = _c(col)
    out = F.lit(None).cast("string")
    for label, low, high in zip(STAR_LABELS, STAR_EDGES, STAR_EDGES[1:]):
        out = F.when((c >= low) & (c < high), F.lit(label)).otherwise(out)
    return out


# --- geography and text ----------------------------------------------------


def haversine(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle distance in metres."""
    phi1, phi2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    half_phi = F.radians(_c(lat2) - _c(lat1)) / F.lit(2.0)
    half_lambda = F.radians(_c(lon2) - _c(lon1)) / F.lit(2.0)
    a = F.pow(F.sin(half_phi), 2.0) + F.cos(phi1) * F.cos(phi2) * F.pow(F.sin(half_lambda), 2.0)
    # rounding may leave [0, 1] by one ulp for antipodes
    a = F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0))
    return F.lit(EARTH_RADIUS_KM * 1000.0 * 2.0) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


NO_LETTERS = r"[^\p{L}]+"


def text_tokens(col: Column | str) -> Column:
    """Lower-case runs of letters of a text."""
    words = F.filter(F.split(_c(col), NO_LETTERS), lambda w: w != "")
    return F.transform(words, lambda w: F.lower(w))


def normalized_text(col: Column | str) -> Column:
    return F.array_join(text_tokens(col), " ")
