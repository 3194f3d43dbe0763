"""Exact Jaccard join of word n-gram sets with prefix filters under several global token orders.

Equal sets are one class, so copies are joined once. A pair of similarity t shares at least l tokens within the prefixes of
n - ceil(t n) + l tokens under any global order. Three orders are used, and a pair must pass all of them before it is verified:

1. by hash: the prefixes of all classes are joined with their counts. A class goes on only if enough of its prefix tokens occur in
   another class (need(n), the smallest l of any partner's size). That leaves few of the classes that have no near copy;
2. by rarity, among the shared tokens that are left: two classes that share need(n) of them share one of the rarest. Here candidates meet;
   passages that many documents have come last in this order;
3. by hash from the other end: checked for each candidate, with the first order, just before its sets are intersected.

Tokens with few classes give pairs of rows. The classes of frequent ones (HOT or more: large groups of near copies) are not paired as
rows: they are cut into blocks by size, and every pair of blocks whose sizes allow a link is one bounded task that compares all its
classes and returns only the links that join something new. No candidate is left out, whatever the size of a group.

Sets are of 64-bit hashes of words. Null and wordless texts have no set and link with nothing; they are their own component. Rows
with a null id take the component of equal sets with ids, null if there is none, and link nothing. Rows that share an id are one
node. Texts are taken whole, whatever their length. An empty table gives no rows. Extra columns are not touched.
"""
import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from kinweave.llm.components import components
from kinweave.llm.tables import cut, free, pieces, texts_of

SIZE, PERCENT = 4, 85
#: Classes of a token from which on they are compared in blocks, and the most classes and tokens of a block.
HOT, BLOCK_SETS, BLOCK_TOKENS = 48, 384, 1 << 18
#: One in so many tokens must be shared beyond the first within a prefix.
SLACK = 20

_MULTIPLY, _SHORT, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


class _Hashes(dict):
    """64-bit hashes of words, kept while there are few."""

    def __missing__(self, word):
        if len(self) > 1 << 18:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(h):
    h = h ^ h >> np.uint64(32)
    h = h * _MIX
    return h ^ h >> np.uint64(29)


def shingle_set(text: bytes, size: int, hashes: dict) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words; fewer words are one run of their own kind."""
    found = text.lower().split()
    if not found:
        return np.empty(0, np.int64)
    w = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    if len(w) < size:
        h = np.full(1, len(w), np.uint64) * _SHORT
        for x in w:
            h = h * _SHORT + x
    else:
        h = w[:len(w) - size + 1].copy()
        for i in range(1, size):
            h = h * _MULTIPLY + w[i:len(w) - size + 1 + i]
    return np.unique(_mixed(h).view(np.int64))


def least_shared(n: int, percent: int) -> int:
    """Fewest tokens that a set of n shares with any set it links to."""
    return -(-percent * n // 100)


def slack(n: int) -> int:
    return max(1, -(-n // SLACK))


def prefix_size(n: int, percent: int) -> int:
    return min(n, n - least_shared(n, percent) + slack(n))


def linked(shared, a, b, percent: int):
    return 100 * shared >= percent * (a + b - shared)


def _signed(size, percent):
    """Of each document: size and digest of its set, and its prefix under the first order."""
    def sign(batches):
        hashes = _Hashes()
        for batch in pieces(batches):
            n, keys, prefixes = [], [], []
            for text in texts_of(batch, "text"):
                s = shingle_set(text or b"", size, hashes)
                n.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                prefixes.append(s[:prefix_size(len(s), percent)])
            ends = np.cumsum([0, *map(len, prefixes)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(prefixes) if prefixes else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), lists], names=["doc_id", "n", "key", "prefix"])
    return sign


def _sets(size):
    def sets(batches):
        hashes = _Hashes()
        for batch in pieces(batches):
            made = [shingle_set(t or b"", size, hashes).tobytes() for t in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.binary())], names=["cls", "set"])
    return sets


def _verified(percent):
    """Pairs (a, b, set_a, set_b) that link; prefixes of both hash orders are met before the whole sets."""
    def passes(x, y):
        m = min(slack(len(x)), slack(len(y)))
        p, q = prefix_size(len(x), percent), prefix_size(len(y), percent)
        common = lambda u, v: len(np.intersect1d(u, v, assume_unique=True))
        return (common(x[:p], y[:q]) >= m and common(x[len(x) - p:], y[len(y) - q:]) >= m
                and linked(common(x, y), len(x), len(y), percent))

    def verify(batches):
        for batch in batches:
            keep = [passes(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64))
                    for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist())]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in (batch.column("a"), batch.column("b"))], names=["a", "b"])
    return verify


def shared_counts(left: list, right: list, columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets of two lists, as products of 0/1 matrices in strips of columns."""
    sizes = [len(s) for s in (*left, *right)]
    token, place = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    more = np.bincount(place, minlength=len(token)) > 1
    number = np.cumsum(more) - 1
    keep = more[place]
    row, col = row[keep], number[place[keep]]
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for start in range(0, int(more.sum()), columns):
        i, j = np.searchsorted(col, [start, start + columns])
        m = np.zeros((len(sizes), columns), np.float32)
        m[row[i:j], col[i:j] - start] = 1
        out += m[:len(left)] @ m[len(left):].T
    return out.astype(np.int64)


def _block_links(percent):
    """Links that join something new among the classes of one pair of blocks."""
    def links(table: pa.Table) -> pa.Table:
        ids, side = table.column("cls").to_numpy(), table.column("side").to_numpy()
        sets = [np.frombuffer(x, np.int64) for x in table.column("set").to_pylist()]
        one, two = np.flatnonzero(side <= 1), np.flatnonzero((side == 0) | (side == 2))
        found = []
        if len(one) and len(two):
            n = np.array([len(s) for s in sets])
            shared = shared_counts([sets[i] for i in one], [sets[i] for i in two])
            a, b = np.nonzero(linked(shared, n[one][:, None], n[two][None, :], percent))
            top = list(range(len(ids)))

            def root(x):
                while top[x] != x:
                    top[x] = top[top[x]]
                    x = top[x]
                return x
            for x, y in zip(one[a], two[b]):
                u, v = root(x), root(y)
                if u != v:
                    top[max(u, v)] = min(u, v)
                    found.append((int(ids[x]), int(ids[y])))
        return pa.table([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])
    return links


def signatures(docs: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return cut(rows.mapInArrow(_signed(size, percent), "doc_id long, n long, key binary, prefix array<long>"), "jaccard-signatures")


def candidates(classes: DataFrame, percent: int) -> DataFrame:
    """(token, cls, n): the rarest shared prefix tokens of the classes that share enough of them."""
    tokens = classes.select(F.explode("prefix").alias("token"), "cls", F.col("n").cast("int").alias("n"))
    shared = cut(tokens.groupBy("token").agg(F.count("*").cast("int").alias("df")).where("df > 1"), "jaccard-shared")
    met = tokens.join(shared, "token")
    of = Window.partitionBy("cls")
    least = ((F.col("n").cast("long") * percent + 99) / 100).cast("long")
    need = F.greatest(F.lit(1).cast("long"), ((least + SLACK - 1) / SLACK).cast("long"))
    ranked = met.withColumns({"_all": F.count("*").over(of), "_rank": F.row_number().over(of.orderBy("df", "token"))})
    return cut(ranked.where((F.col("_all") >= need) & (F.col("_rank") <= F.col("_all") - need + 1)).select("token", "cls", "n"), "jaccard-candidates")


def hot_units(members: DataFrame, percent: int) -> DataFrame:
    """(unit, side, cls): the pairs of blocks that the classes of frequent tokens take part in.

    Classes that frequent tokens connect form a group; its classes are cut by size so that only neighbouring sizes can link, and each size
    into blocks of bounded classes and tokens. side is 0 where both blocks are the same, else 1 or 2.
    """
    hubs = cut(members.groupBy("token").agg(F.min("cls").alias("hub")), "jaccard-hubs")
    joined = members.join(hubs, "token")
    group = cut(components(joined.select(F.col("hub").alias("a"), F.col("cls").alias("b")).distinct()), "jaccard-groups")
    sized = members.select("cls", "n").distinct().join(group, F.col("cls") == F.col("node")).select(
        "cls", "n", F.col("component").alias("group"), F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(percent / 100))).cast("int").alias("step"))
    sized = cut(sized, "jaccard-sized")
    blocks = cut(sized.groupBy("group", "step").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_TOKENS)).cast("int").alias("blocks")), "jaccard-blocks")
    at = lambda shift, name: blocks.select(F.col("group"), (F.col("step") + shift).alias("step"), F.col("blocks").alias(name))
    placed = (sized.join(at(0, "own"), ["group", "step"]).join(at(-1, "above"), ["group", "step"], "left").join(at(1, "below"), ["group", "step"], "left")
              .withColumn("block", F.pmod(F.xxhash64("cls"), F.col("own")).cast("int")))

    def upto(count):
        return F.when(F.coalesce(count, F.lit(0)) > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))

    def unit(s, i, t, j, side):
        return F.struct(F.concat_ws("/", "group", s, i, t, j).alias("unit"), side.alias("side"))
    step, block, zero = F.col("step"), F.col("block"), F.lit(0)
    same = F.transform(upto(F.col("own")), lambda j: unit(step, F.least(block, j), step, F.greatest(block, j), F.when(j == block, 0).when(block < j, 1).otherwise(2)))
    up = F.transform(upto(F.col("above")), lambda j: unit(step, block, step + 1, j, zero + 1))
    down = F.transform(upto(F.col("below")), lambda j: unit(step - 1, j, step, block, zero + 2))
    return placed.select("cls", F.explode(F.concat(same, up, down)).alias("_u")).select("_u.unit", "_u.side", "cls")


def links(docs: DataFrame, classes: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """(a, b): links between classes, enough of them to connect all that are connected."""
    met = candidates(classes, percent)
    counts = cut(met.groupBy("token").agg(F.count("*").cast("int").alias("classes")).where("classes > 1"), "jaccard-tokens")
    # Written before it is joined with itself, so that frequent tokens are split off in a join that can deal them out.
    few = cut(met.join(counts.where(F.col("classes") < HOT), "token").select("token", "cls", "n"), "jaccard-few")
    other = few.select("token", F.col("cls").alias("b"), F.col("n").alias("m"))
    near = (100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
    pairs = cut(few.withColumnRenamed("cls", "a").join(other, "token").where((F.col("a") < F.col("b")) & near).select("a", "b").distinct(), "jaccard-pairs")
    members = cut(met.join(counts.where(F.col("classes") >= HOT), "token").select("token", "cls", "n"), "jaccard-frequent")
    units = cut(hot_units(members, percent), "jaccard-units")
    wanted = cut(pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).unionByName(units.select("cls")).distinct(), "jaccard-wanted")
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).join(wanted, F.col("doc_id") == F.col("cls"), "left_semi")
    sets = cut(texts.mapInArrow(_sets(size), "cls long, set binary"), "jaccard-sets")
    both = (pairs.join(sets.select(F.col("cls").alias("a"), F.col("set").alias("set_a")), "a")
            .join(sets.select(F.col("cls").alias("b"), F.col("set").alias("set_b")), "b"))
    by_pair = both.select("a", "b", "set_a", "set_b").mapInArrow(_verified(percent), "a long, b long")
    by_block = units.join(sets, "cls").groupBy("unit").applyInArrow(_block_links(percent), "a long, b long")
    return by_pair.unionByName(by_block)


def join_components(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row."""
    signed = signatures(docs, key, text, size, percent)
    classes = cut(signed.where("n > 0 AND doc_id IS NOT NULL").groupBy("key").agg(
        F.min("doc_id").alias("cls"), F.first("n").alias("n"), F.first("prefix").alias("prefix")), "jaccard-classes")
    found = components(links(docs, classes, key, text, size, percent))
    named = cut(classes.select("key", "cls").join(found, F.col("cls") == F.col("node"), "left")
                .select("key", F.coalesce("component", "cls").alias("component_id")), "jaccard-components")
    rows = signed.select("doc_id", "n", "key").join(named.withColumnRenamed("key", "of"), F.col("key") == F.col("of"), "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"),
                       F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", **settings) -> DataFrame:
    """The document with the smallest id of each component, and every row without a component; rows that share an id stay together."""
    gone = free(docs, "dropped")
    found = join_components(docs, key, **settings).where(F.col("doc_id").isNotNull() & (F.col("component_id") < F.col("doc_id")))
    return docs.join(cut(found.select(F.col("doc_id").alias(gone)).distinct(), "jaccard-dropped"), F.col(key).cast("long") == F.col(gone), "left_anti")
