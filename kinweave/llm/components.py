"""Connected components of an edge table by alternating large and small stars, each round written out."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.tables import cut

MAX_ROUNDS = 60


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node that has an edge, with the smallest node it reaches. Loops and null ends are ignored.

    Edges are held as v < u. A large star links what lies above a node to the smallest of its neighbours, a small star what lies below;
    the number of edges never grows, and paths shorten by a doubling step. Minima are summed per task before the shuffle and joined back
    from a written table, so that a node with any number of neighbours can be split.
    """
    held = cut(edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).where("u <> v").distinct(), "edges")
    before = _state(held)
    for _ in range(MAX_ROUNDS):
        around = held.unionByName(held.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = cut(around.groupBy(F.col("v").alias("node")).agg(F.least(F.min("u"), F.min("v")).alias("root")), "roots")
        large = cut(held.join(least, held["v"] == least["node"]).select(F.col("root").alias("v"), "u").distinct(), "edges")
        least = cut(large.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")), "roots")
        below = large.join(least, large["u"] == least["node"]).where("v <> root").select(F.col("root").alias("v"), F.col("v").alias("u"))
        held = cut(below.unionByName(least.select(F.col("root").alias("v"), F.col("node").alias("u"))).distinct(), "edges")
        after = _state(held)
        if after == before:
            # Nothing moved: every edge leads from a root to one of its members.
            return held.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                held.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        before = after
    raise RuntimeError("components did not settle")
