"""Spans of pattern matches by built-in functions only: the matches and the gaps between them give every position."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,end:int,value:string>>"


def with_matches(df: DataFrame, text: str, name: str, pattern: str, holds: str | None = None, around: int = 0) -> DataFrame:
    """Add array<struct<start, end, value>> of the leftmost non-overlapping matches, in code points with the end exclusive.

    A text splits at its matches, so match i starts after gaps 0 to i and matches 0 to i - 1. Texts in which `holds` (the pattern itself,
    or a cheaper one that every text with a match fulfils) is not found skip the work. The pattern must not match nothing. `around` adds up to so many characters of text `before` and `after`
    each match, taken from the gaps and matches beside it.
    """
    found = F.col(text).rlike(holds or pattern)
    none = F.array().cast("array<string>")
    values, gaps = f"_{name}_values", f"_{name}_gaps"
    split = df.withColumns({values: F.when(found, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).otherwise(none),
                            gaps: F.when(found, F.transform(F.split(F.col(text), pattern, -1), lambda g: F.length(g))).otherwise(F.array().cast("array<int>"))})
    # Ends of the matches by one running sum over (gap, match) lengths.
    sums = F.aggregate(F.sequence(F.lit(0), F.size(values) - 1), F.array(F.lit(0)),
                       lambda ends, i: F.concat(ends, F.array(F.element_at(ends, -1) + F.get(gaps, i) + F.length(F.get(values, i)))))
    ends, texts, kind = f"_{name}_ends", f"_{name}_texts", SPANS
    split = split.withColumn(ends, F.when(F.size(values) > 0, sums))
    beside = lambda i: []
    if around:
        kind = SPANS.replace("value:string", "value:string,before:string,after:string")
        split = split.withColumn(texts, F.when(F.size(values) > 0, F.transform(F.split(F.col(text), pattern, -1), lambda g: F.struct(
            F.substring(g, 1, around).alias("head"), F.substring(g, -around, around).alias("tail")))))
        part = lambda i, end: F.coalesce(F.get(texts, i)[end], F.lit(""))
        value = lambda i: F.coalesce(F.get(values, i), F.lit(""))
        beside = lambda i: [F.substring(F.concat(part(i - 2, "tail"), value(i - 2), part(i - 1, "tail"), value(i - 1), part(i, "tail")), -around, around).alias("before"),
                            F.substring(F.concat(part(i + 1, "head"), value(i + 1)), 1, around).alias("after")]
    return (split.withColumn(name, F.when(F.size(values) > 0, F.transform(F.col(values), lambda v, i: F.struct(
                (F.get(ends, i + 1) - F.length(v)).alias("start"), F.get(ends, i + 1).alias("end"), v.alias("value"), *beside(i))))
                        .otherwise(F.array().cast(kind))).drop(values, gaps, ends, texts))


def named(spans: Column, kind: str, rank: int) -> Column:
    """(start, rank, end, kind): sorts by start, then by the order in which kinds are listed."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def written_out(spans: Column) -> Column:
    """kind:start:end by start, then rank, joined by commas."""
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
