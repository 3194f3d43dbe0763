"""Values and wording inside free text."""
from pyspark.sql import Column, functions as F

from kinweave import settings as S


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def exploded(df, keys, array, name):
    """Elements of a computed array as rows. The outer form keeps the array from being worked out again in a filter below."""
    return df.select(*keys, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def redact(c) -> Column:
    """Keys and tokens replaced by stars."""
    c = _c(c)
    for pattern, shown in S.REDACTIONS:
        c = F.regexp_replace(c, pattern, shown)
    return c


def extract_codes(c) -> Column:
    """Six-digit codes that are not part of a longer number."""
    return F.regexp_extract_all(_c(c), F.lit(r"(?<!\d)(\d{6})(?!\d)"), 1)


def extract_percents(c) -> Column:
    return F.regexp_extract_all(_c(c), F.lit(S.PERCENT_PATTERN), 1)


def extract_counts(c) -> Column:
    return F.regexp_extract_all(_c(c), F.lit(S.COUNT_PATTERN), 1)


def extract_amounts(c) -> Column:
    """Array of 'number|unit'."""
    return F.transform(F.regexp_extract_all(_c(c), F.lit(S.AMOUNT_PATTERN), 0),
                       lambda m: F.regexp_replace(m, "^" + S.AMOUNT_PATTERN + "$", "$1|$2"))


def extract_dates(c) -> Column:
    """Array of YYYY-MM or YYYY-MM-DD, padded. The text is scanned once; parts are read from what matched."""
    def iso(m):
        day = F.regexp_extract(m, S.DATE_PATTERN, 3)
        month = F.concat(F.left(m, F.lit(4)), F.lit("-"), F.lpad(F.regexp_extract(m, S.DATE_PATTERN, 2), 2, "0"))
        return F.when(day != "", F.concat(month, F.lit("-"), F.lpad(day, 2, "0"))).otherwise(month)
    return F.transform(F.regexp_extract_all(_c(c), F.lit(S.DATE_PATTERN), 0), iso)


def values_of(c) -> Column:
    """All values of a text as array of (kind, value)."""
    def tagged(kind, arr):
        return F.transform(arr, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    return F.concat(tagged("percent", extract_percents(c)), tagged("amount", extract_amounts(c)),
                    tagged("date", extract_dates(c)), tagged("count", extract_counts(c)))


def wording_hits(c) -> Column:
    """Evaluative, investment and causal wording as array of (kind, value), cut to 50 characters."""
    def one(label, pattern):
        return F.transform(F.regexp_extract_all(_c(c), F.lit(pattern), 0),
                           lambda v: F.struct(F.lit(label).alias("kind"), F.left(v, F.lit(50)).alias("value")))
    return F.concat(*[one(label, pattern) for label, pattern in S.WORDING_CLASSES])


def organisation_names(c) -> Column:
    """Names ending in an organisation suffix."""
    return F.array_distinct(F.transform(F.regexp_extract_all(_c(c), F.lit(S.ORG_IN_TEXT), 1), lambda x: F.trim(x)))
