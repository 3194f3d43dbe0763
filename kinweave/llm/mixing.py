"""Mixing sources to target weights by capped water-filling.

Every source may give at most `epochs` times its words. Shares follow the weights; what a source cannot give is shared again by
weight among the others until none is above its cap. The document level repeats: all documents of a source are taken
floor(target / size) times, and once more those that come first in a seeded order until the rest of the target is met; the document
at the edge is taken if that comes nearer. Nothing depends on row order, partitions or time, so reruns agree.

A null text has no words. Null sources form a source of their own, last in order. A source without words has target 0 and gives
nothing. Repeated rows count and are taken each on its own; their order among equal keys does not change what is taken in sum. An
empty table gives no rows.
"""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from kinweave.llm.tables import WORD, cut, whole_row

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(key: Column, seed: str = SEED) -> Column:
    """Place of a document in the seeded order: hex digits that any engine can compute."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))))


def water_fill(sources: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size -> also target. One row per source is all that is ordered here.

    With sources in the order of cap / weight, the first k are capped for the smallest k at which the common level of the others,
    (total - caps of the k) / (their weight), is within the cap of the next one. Sums are whole numbers and the level is one
    division, so the targets are the same on every engine.
    """
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = (sources.withColumn("_w", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
               .withColumn("_cap", F.col("source_size") * epochs))
    fill = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    upto, whole = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    levelled = (weighed
                .withColumn("_rest", F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(upto), F.lit(0)))
                .withColumn("_weight", F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(upto), F.lit(0)))
                .withColumn("_open", F.col("_rest") * F.col("_w") <= F.col("_cap") * F.col("_weight")))
    # The first source that need not be capped sets the level of all after it.
    first = levelled.withColumn("_k", F.row_number().over(fill)).withColumn(
        "_at", F.min(F.when(F.col("_open"), F.struct("_k", "_rest", "_weight"))).over(whole))
    shared = (F.col("_w") * F.col("_at._rest")).cast("double") / F.col("_at._weight").cast("double")
    target = F.when(F.col("_k") < F.col("_at._k"), F.col("_cap").cast("double")).otherwise(shared)
    return first.select("source", "source_size", target.alias("target"))


def plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, epochs: int = EPOCHS,
         seed: str = SEED) -> DataFrame:
    """key, size, source_size, target and times (how often the mix takes the row), one row per row.

    The seeded order of a source is cut into 4,096 pieces by its first digits; only sums of pieces are ordered per source, and only
    rows within a piece are sorted, so a source with a third of all rows is spread over 4,096 groups.
    """
    rows = cut(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
                           draw(F.col(key), seed).alias("draw"))
               .withColumn("piece", F.substring("draw", 1, 3)), "mix-rows")
    pieces = cut(rows.groupBy("source", "piece").agg(F.sum("size").alias("words")), "mix-pieces")
    targets = water_fill(pieces.groupBy("source").agg(F.sum("words").alias("source_size")), weights, epochs)
    before = Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    begun = pieces.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words")
    placed = cut(begun.join(targets, begun["source"].eqNullSafe(targets["source"])).drop(targets["source"])
                 .withColumnRenamed("source", "of").withColumnRenamed("piece", "at"), "mix-places")
    joined = rows.join(placed, rows["source"].eqNullSafe(placed["of"]) & (rows["piece"] == placed["at"]))
    within = (Window.partitionBy("source", "piece").orderBy("draw", F.col("key").asc_nulls_first(), "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("target") - whole * F.col("source_size")
    ends = F.col("start") + F.coalesce(F.sum("size").over(within), F.lit(0)) + F.col("size") / 2
    return joined.select("key", "size", "source_size", "target", (whole + F.when(ends <= rest, 1).otherwise(0)).alias("times"))


def mix_words(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    return plan(docs, **settings).select(F.col("key").alias("doc_id"), "size", "source_size", "target",
                                         (F.col("size") * F.col("times")).alias("taken"))


def mixed(docs: DataFrame, key: str = "doc_id", **settings) -> DataFrame:
    """The documents of the mix, each as often as it is taken. Rows that share a key share its number; keys are joined, not texts
    compared, and documents that are not taken are dropped before the texts move."""
    taken = plan(docs, key=key, **settings).where("times > 0").groupBy("key").agg(F.max("times").alias("times"))
    rows = docs.select(F.col(key).alias("of"), whole_row(docs).alias("row"))
    kept = rows.join(cut(taken, "mix-times"), F.col("of").eqNullSafe(F.col("key")))
    return kept.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("row.*")


MIX_SQL = r"""
sized AS (SELECT doc_id, source, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS draw,
    coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM {docs}),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT source, source_size, 3 * source_size AS cap,
    [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM sources),
levels AS (SELECT *, row_number() OVER f AS k,
    sum(source_size) OVER () - coalesce(sum(cap) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(w) OVER () - coalesce(sum(w) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight
    FROM weighed WINDOW f AS (ORDER BY cap / w, source NULLS LAST)),
edge AS (SELECT k AS edge_k, rest AS r, weight AS g FROM levels WHERE rest * w <= cap * weight ORDER BY k LIMIT 1),
targets AS (SELECT source, source_size,
    CASE WHEN k < edge_k THEN CAST(cap AS DOUBLE) ELSE CAST(w * r AS DOUBLE) / CAST(g AS DOUBLE) END AS target FROM levels, edge),
placed AS (SELECT s.doc_id, s.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.draw, s.doc_id NULLS FIRST, s.size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + s.size / 2 AS ends
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
mix AS (SELECT doc_id, size, source_size, target,
    whole + CASE WHEN ends <= target - whole * source_size THEN 1 ELSE 0 END AS times FROM placed)"""
