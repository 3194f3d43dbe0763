"""Centroid clustering of whole-number vectors with a vantage-point tree over the centroids.

Vectors of the right size without null and non-finite components are kept; every component x becomes floor(scale * x). All that follows
is exact: distances are squared and whole, means are rounded down from exact sums. In every round the tree over the
centroids is built anew and broadcast (`k` centroids, whatever the data), every vector is assigned by it, and each task returns one
row of sums for each cluster it met, so that k rows a task are shuffled and k are returned to the driver.

The search is best-first, for a batch of vectors at a time: each vector goes on with the open branch of its own that has the smallest
bound, until that bound lies beyond its best distance. Bounds come from the triangle inequality in doubles, widened by more
than their rounding; a branch at exactly the best distance is still visited, since it may hold an equally near centroid with a smaller number.
Distances are compared as whole numbers.

Vectors with a component of 2^27 or more after scaling are left out like non-finite ones: their squared distances would not fit a
long. Rows that share an id are vectors of their own; among the first centroids ties of the hash are broken by id (null last), then components. With
fewer vectors than k there are fewer centroids; centroids without vectors stay where they are. Sums that do not fit a long are null.
An empty table gives no rows; other columns are not touched.
"""
import hashlib
import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.tables import cut

SIZE, SCALE, CLUSTERS, ROUNDS, SEED = 64, 256, 40, 5, 2
LIMIT = 1 << 27
#: Centroids of a leaf of the tree, and vectors searched at once.
LEAF, BATCH = 4, 4096


def squared(vectors: np.ndarray, point: np.ndarray) -> np.ndarray:
    away = vectors - point
    return np.einsum("ij,ij->i", away, away)


class VantageTree:
    """Nodes are (number, rings): a centroid to measure from and for each branch (node, smallest, largest distance), or (numbers,) for a leaf."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.leaf, self.nodes = points, leaf, []
        self.root = self._grow(list(range(len(points)))) if len(points) else None

    def _grow(self, members):
        at = len(self.nodes)
        self.nodes.append(None)
        if len(members) <= self.leaf:
            self.nodes[at] = (np.array(members),)
            return at
        # The member farthest from the first one: from there the distances differ most.
        far = int(np.argmax(squared(self.points[members], self.points[members[0]])))
        point, rest = members[far], members[:far] + members[far + 1:]
        away = squared(self.points[rest], self.points[point])
        order = np.argsort(away, kind="stable")
        rings = []
        for part in (order[:len(order) // 2], order[len(order) // 2:]):
            if len(part):
                rings.append((self._grow([rest[i] for i in part]), math.sqrt(int(away[part].min())), math.sqrt(int(away[part].max()))))
        self.nodes[at] = (point, rings)
        return at

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of each vector's nearest centroid, the smaller number where two are as near."""
        n = len(vectors)
        best, number = np.full(n, np.iinfo(np.int64).max), np.full(n, len(self.points))
        bounds = np.full((n, len(self.nodes)), np.inf)
        bounds[:, self.root] = 0.0
        active = np.arange(n)

        def meet(rows, away, which):
            nearer = (away < best[rows]) | (away == best[rows]) & (which < number[rows])
            best[rows[nearer]], number[rows[nearer]] = away[nearer], which

        while len(active):
            choice = bounds[active].argmin(1)
            bound = bounds[active, choice]
            # Inclusive: a branch goes only if its bound is beyond the best distance by more than rounding.
            on = bound <= np.sqrt(best[active].astype(np.float64)) * (1 + 1e-9) + 1e-6
            active, choice = active[on & np.isfinite(bound)], choice[on & np.isfinite(bound)]
            for c in np.unique(choice):
                rows, node = active[choice == c], self.nodes[c]
                bounds[rows, c] = np.inf
                if len(node) == 1:
                    for which in node[0]:
                        meet(rows, squared(vectors[rows], self.points[which]), which)
                    continue
                point, rings = node
                away = squared(vectors[rows], self.points[point])
                meet(rows, away, point)
                d = np.sqrt(away.astype(np.float64))
                for child, low, high in rings:
                    gap = np.maximum(low - d, d - high)
                    bounds[rows, child] = np.maximum(0.0, gap - 1e-9 * (d + high))
        return number, best


def _vectors(batch):
    column = batch.column("vector")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _nearest(tree, batch):
    vectors = _vectors(batch)
    parts = [tree.nearest(vectors[i:i + BATCH]) for i in range(0, len(vectors), BATCH)]
    return vectors, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _summed(shared):
    """(cluster, n, sums): one row for each cluster a task meets."""
    def add(batches):
        tree = shared.value
        n, sums = np.zeros(len(tree.points), np.int64), np.zeros(tree.points.shape, np.int64)
        for batch in batches:
            if batch.num_rows:
                vectors, number, _ = _nearest(tree, batch)
                n += np.bincount(number, minlength=len(n))
                order = np.argsort(number, kind="stable")
                met, start = np.unique(number[order], return_index=True)
                sums[met] += np.add.reduceat(vectors[order], start, axis=0)
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(n[met]), pa.array(list(sums[met]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])
    return add


def _assigned(shared):
    def assign(batches):
        tree = shared.value
        for batch in batches:
            if batch.num_rows:
                _, number, best = _nearest(tree, batch)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(best)], names=["vec_id", "cluster", "distance"])
    return assign


def whole_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """(vec_id, vector): the vectors kept, components as whole numbers."""
    x = F.col(vector)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double") * scale) >= LIMIT))
    kept = vectors.where(x.isNotNull() & (F.size(x) == size)).where(~F.coalesce(bad, F.lit(True)))
    return kept.select(F.col(key).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("int")).alias("vector"))


def _moved(points, shared, rows):
    """The means of the assigned vectors, rounded down; where there are none the old centroid."""
    sums = rows.mapInArrow(_summed(shared), "cluster int, n long, sums array<long>")
    total = sums.select("cluster", "n", F.posexplode("sums").alias("at", "x")).groupBy("cluster", "at").agg(
        F.sum(F.col("n").cast("decimal(20,0)")).alias("n"), F.sum(F.col("x").cast("decimal(20,0)")).alias("x"))
    points = points.copy()
    for r in total.collect():
        points[r.cluster, r["at"]] = int(r.x) // int(r.n)
    return points


def cluster(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", size: int = SIZE, scale: int = SCALE, k: int = CLUSTERS,
            rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row for each vector kept."""
    context = vectors.sparkSession.sparkContext
    rows = cut(whole_vectors(vectors, key, vector, size, scale), "centroid-vectors")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.orderBy(hashed, F.asc_nulls_last("vec_id"), "vector").limit(k).select("vector").collect()
    points = np.array([r.vector for r in first], np.int64).reshape(len(first), size)
    if not len(first):
        return rows.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (
            ("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    for _ in range(rounds):
        shared = context.broadcast(VantageTree(points))
        points = _moved(points, shared, rows)
        shared.unpersist()
    shared = context.broadcast(VantageTree(points))
    found = cut(rows.mapInArrow(_assigned(shared), "vec_id long, cluster int, distance long"), "centroid-clusters")
    per = {r.cluster: int(r.d) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("d")).collect()}
    total = sum(per.values())
    digests = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points.tolist()]
    # One row for each centroid, so the broadcast is bounded by k.
    facts = vectors.sparkSession.createDataFrame([(c, Decimal(d), Decimal(total), digests[c]) for c, d in per.items()],
                                                 "cluster int, a decimal(38,0), b decimal(38,0), centroid_sha256 string")
    facts = facts.select("cluster", F.expr("try_cast(a AS bigint)").alias("cluster_inertia"), F.expr("try_cast(b AS bigint)").alias("inertia"), "centroid_sha256")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def cluster_sql(size: int = SIZE, scale: int = SCALE, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> str:
    """DuckDB SQL for the same rows of the table embeddings."""
    near = """near{i} AS MATERIALIZED (SELECT row_no, vec_id, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d, any_value(v) AS v FROM (
  SELECT r.row_no, r.vec_id, c.cluster, r.v, list_sum(list_transform(list_zip(r.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
  FROM kept r CROSS JOIN centroid{i} c) GROUP BY row_no, vec_id)"""
    move = """centroid{j} AS MATERIALIZED (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM centroid{i} c LEFT JOIN (
  SELECT cluster, list(mean ORDER BY place) AS v FROM (
    SELECT cluster, place, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*))::HUGEINT // count(*) AS mean FROM (
      SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM near{i}) GROUP BY cluster, place) GROUP BY cluster) m USING (cluster))"""
    steps = ",\n".join(near.format(i=i) + ",\n" + move.format(i=i, j=i + 1) for i in range(rounds))
    return f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')), vec_id NULLS LAST, v) - 1 AS row_no, vec_id, v FROM (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * x::DOUBLE) AS HUGEINT)) AS v FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs(x::DOUBLE * {scale}) < {LIMIT})) = {size})),
centroid0 AS MATERIALIZED (SELECT row_no AS cluster, v FROM kept WHERE row_no < {k}),
{steps},
{near.format(i=rounds)}
SELECT n.vec_id, n.cluster::INTEGER AS cluster, n.d AS distance, sum(n.d) OVER (PARTITION BY n.cluster)::BIGINT AS cluster_inertia, sum(n.d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM near{rounds} n JOIN centroid{rounds} c USING (cluster)"""
