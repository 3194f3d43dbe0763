"""Joins through hub keys.

A holder, a controller or a board member can sit on a large part of all rows, and a key with n rows on one side and m on the other
gives n x m pairs. Keys with more pairs than one task should make are cut into a rectangle of tasks: the left rows of the key into parts
by a hash, the right ones likewise, and every part of one side meets every part of the other once. The numbers of parts come from the counts
of both sides (one partial aggregation each); there is no hint, so a small share table is broadcast by its measured size and a
large one is shuffled. Nothing is dropped. A join without such keys stays as it is.
"""
from pyspark.sql import DataFrame, functions as F

from kinweave.session import written

#: A task makes up to HOT_ROWS x HOT_ROWS pairs of a key.
HOT_ROWS = 2_048
#: Sides of the rectangles of paired_except, and the pairs it aims at a task.
RECTANGLE_ROWS, TASK_PAIRS = 1_024, 1_000_000
#: Buckets in which keys are counted before they are counted one by one.
BUCKETS = 262_144


def key_shares(left: DataFrame, right: DataFrame, keys, hot_rows=None) -> DataFrame:
    """Keys with more pairs than one task should make, with the parts of each side.

    A side with few rows stays whole, and the other one is cut more often, so that neither side is repeated more than its partner asks for.
    """
    hot_rows = hot_rows or HOT_ROWS
    n = left.groupBy(*keys).agg(F.count("*").alias("_n"))
    m = right.groupBy(*keys).agg(F.count("*").alias("_m"))
    hot = n.join(m, keys).where(F.col("_n").cast("double") * F.col("_m") > float(hot_rows) * hot_rows)
    a, b = F.col("_n") / hot_rows, F.col("_m") / hot_rows
    return hot.select(*keys, F.ceil(F.when(b < 1, a * b).otherwise(a)).cast("int").alias("_rows"),
                      F.ceil(F.when(a < 1, a * b).otherwise(b)).cast("int").alias("_columns"))


def may_be_hot(left: DataFrame, right: DataFrame, keys, hot_rows=None) -> bool:
    """Whether a key may have more pairs than one task should make. Keys are counted by buckets of their hash, which costs no shuffle of the keys; a key has
    no more rows than its bucket."""
    hot_rows = hot_rows or HOT_ROWS
    of = lambda df, name: df.select(F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("_bucket")).groupBy("_bucket").agg(F.count("*").alias(name))
    pairs = F.col("_n").cast("double") * F.col("_m")
    return bool(of(left, "_n").join(of(right, "_m"), "_bucket").where(pairs > float(hot_rows) * hot_rows).head(1))


def spread_join(left: DataFrame, right: DataFrame, keys, row_key, how="inner", hot_rows=None, right_key=None) -> DataFrame:
    """Equi-join of left and right on keys. Hot keys are dealt out by hashes of row_key (left) and right_key (all columns of the right).

    The keys are counted when the join is put together: without hot ones it stays a plain join, and otherwise their shares are a written table.
    """
    shares = key_shares(left, right, keys, hot_rows)
    if not shares.head(1):
        return left.join(right, keys, how)
    shares = written(shares, "hot-keys")
    rows, columns = F.coalesce("_rows", F.lit(1)), F.coalesce("_columns", F.lit(1))
    part = lambda key, n: F.pmod(F.xxhash64(*key), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = left.join(shares, keys, "left").withColumn("_at", part(row_key, rows)).withColumn("_by", every(columns)).drop("_rows", "_columns")
    other = right.join(shares, keys, "left").withColumn("_by", part(right_key or right.columns, columns)).withColumn("_at", every(rows)).drop("_rows", "_columns")
    return own.join(other, [*keys, "_at", "_by"], how).drop("_at", "_by")


def paired_except(left: DataFrame, right: DataFrame, keys, left_key, right_key, known: DataFrame, side=None) -> DataFrame:
    """Every row of left with every row of right under equal keys, but for the pairs of known (keys, left_key, right_key).

    Only the two sides and the known pairs are shuffled, never the pairs: each key is cut into rectangles, a left row carries the known partners it has
    in each column, and the tasks, whose number follows from the pairs counted beforehand, make their pairs as they are read. Null keys meet nothing.
    """
    side = side or RECTANGLE_ROWS
    n = left.groupBy(*keys).agg(F.count("*").alias("_n"))
    m = right.groupBy(*keys).agg(F.count("*").alias("_m"))
    cut = lambda c: F.ceil(F.col(c) / side).cast("int")
    shares = written(n.join(m, keys).select(*keys, cut("_n").alias("_rows"), cut("_m").alias("_columns"), (F.col("_n") * F.col("_m")).alias("_pairs")), "rectangles")
    tasks = max(1, -(-(shares.agg(F.sum("_pairs")).first()[0] or 0) // TASK_PAIRS))
    shares = shares.drop("_pairs")
    part = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    skip = known.join(shares, keys).withColumn("_by", part(right_key, F.col("_columns"))).groupBy(*keys, left_key, "_by").agg(F.collect_set(right_key).alias("_known"))
    own = left.join(shares, keys).withColumns({"_at": part(left_key, F.col("_rows")), "_by": every("_columns")}).drop("_rows", "_columns")
    own = own.join(skip, [*keys, left_key, "_by"], "left").repartition(tasks, *keys, "_at", "_by")
    other = right.join(shares, keys).withColumns({"_by": part(right_key, F.col("_columns")), "_at": every("_rows")}).drop("_rows", "_columns")
    met = own.join(other, [*keys, "_at", "_by"])
    return met.where(~F.coalesce(F.array_contains("_known", F.col(right_key)), F.lit(False))).drop("_at", "_by", "_known")
