"""SimHash fingerprints and their exact near-duplicate join by a vantage-point tree.

A fingerprint has 64 bits; a bit is 1 where more than half of the shingles' hashes have it. Two fingerprints link when at most `bits` of
them differ. Equal fingerprints are one class, so copies are joined once.

The tree parts fingerprints by Hamming distance to one vantage point, taken from the data. Its root looks at the distance over all 64
bits; every further level cuts each stretch of bits into halves and looks at the distance on each. By the triangle inequality
two fingerprints that differ in b bits differ by b at most in the distance on any stretch, and as stretches are disjoint those differences
may be added up: a query visits the shards whose distances differ from its own by `bits` in total, its own shard and those across
a boundary. A shard with more than `leaf` classes is split by the next level; on the last one every stretch is a bit and a shard one
class, so any crowd of near copies comes apart, and no shard has to be compared as a whole. In a shard the search goes on from
vantage points of its own. A shard returns links that connect what is connected in it, not all of its pairs.

Texts are lower-cased in A-Z only and split at ASCII white space. Null and wordless texts have fingerprint zero and link like any
other. Texts of fewer words than a shingle are one shingle. A text is read in parts, so its length does not matter. Rows with a null
id take the component of an equal fingerprint that has ids, else null, and link nothing. Repeated rows and rows that share an id
are kept, each with the result of its own text. An empty table gives no rows; other columns are not touched.
"""
from functools import lru_cache, partial
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.components import components
from kinweave.llm.tables import cut

SIZE, SEED, BITS = 3, 42, 2
#: Classes of a shard from which on it is split, and queries that one task compares with a shard.
LEAF, QUERIES = 1 << 14, 1 << 15
#: Pairs compared at once, and shingles hashed at once.
PAIRS, PART = 1 << 20, 1 << 16


def fingerprint(text: bytes, size: int = SIZE) -> int:
    """Majority of the shingle hashes, bit by bit, as an unsigned number."""
    words = text.lower().split()
    if not words:
        return 0
    made = [b" ".join(words)] if len(words) < size else None
    n = 1 if made else len(words) - size + 1
    ones = np.zeros(64, np.int64)
    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    for start in range(0, n, PART):
        count = min(PART, n - start)
        part = made or map(b" ".join, zip(*(words[start + i:start + i + count] for i in range(size))))
        hashes = np.fromiter(map(digest, part), np.uint64, count)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _signed(size):
    def sign(batches):
        for batch in batches:
            prints = [fingerprint(t or b"", size) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(prints, np.uint64).view(np.int64))], names=["doc_id", "print"])
    return sign


def ring(prints: np.ndarray, vantage: np.uint64, stretches: int) -> np.ndarray:
    """Distances to the vantage point on each stretch of bits, one row for each fingerprint."""
    width = 64 // stretches
    full = np.uint64(2**width - 1 if width < 64 else 2**64 - 1)
    shifts = (np.arange(stretches, dtype=np.uint64) * np.uint64(width))[None, :]
    return np.bitwise_count((prints ^ vantage)[:, None] >> shifts & full).astype(np.int8)


@lru_cache(maxsize=4096)
def steps(of: tuple, bits: int) -> np.ndarray:
    """All ways to go `bits` steps at most on the halves of the stretches, by what they sum up to on the stretches (of)."""
    ways = [[]]
    for total in of:
        pairs = [(a, total - a) for a in range(-bits, bits + 1) if abs(a) + abs(total - a) <= bits]
        ways = [[*w, *p] for w, p in product(ways, pairs) if sum(map(abs, w)) + sum(map(abs, p)) <= bits]
    return np.array(ways, np.int8).reshape(len(ways), 2 * len(of))


def _visits(cells, prints, vantage, stretches, bits):
    """(row, cell) of the next level's shards that queries of these cells visit; stretches are those of the next level."""
    own = ring(prints, vantage, stretches)
    if stretches == 1:
        away = np.arange(-bits, bits + 1, dtype=np.int8)
        rows, cell = np.repeat(np.arange(len(prints)), len(away)), (own + away[None, :]).reshape(-1, 1)
    else:
        off = cells - (own[:, ::2] + own[:, 1::2])
        kinds, kind = np.unique(off, axis=0, return_inverse=True)
        rows, cell = [np.empty(0, np.int64)], [np.empty((0, stretches), np.int8)]
        for k, of in enumerate(kinds):
            at = np.flatnonzero(kind.reshape(-1) == k)
            ways = steps(tuple(map(int, of)), bits)
            rows.append(np.repeat(at, len(ways)))
            cell.append((own[at][:, None, :] + ways[None, :, :]).reshape(-1, stretches))
        rows, cell = np.concatenate(rows), np.concatenate(cell)
    inside = ((cell >= 0) & (cell <= 64 // stretches)).all(1)
    rows, cell = rows[inside], cell[inside]
    return rows, cell, (cell == own[rows]).all(1)


def _split(vantage, stretches, bits):
    """Rows (cell, print, home) go to the shards of the next level; home is where a class is held, elsewhere it only asks."""
    v = np.uint64(vantage)

    def split(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                prints = batch.column("print").to_numpy(zero_copy_only=False).view(np.uint64)
                home = batch.column("home").to_numpy(zero_copy_only=False).astype(bool)
                cells = np.frombuffer(b"".join(batch.column("cell").to_pylist()), np.int8).reshape(len(prints), -1)
                rows, cell, own = _visits(cells, prints, v, stretches, bits)
                flat = np.ascontiguousarray(cell).view(np.uint8).reshape(-1)
                ends = np.arange(len(rows) + 1, dtype=np.int32) * stretches
                column = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([column, pa.array(prints[rows].view(np.int64)), pa.array(home[rows] & own)], names=["cell", "print", "home"])
    return split


class Joined:
    """What is connected among some members, as the smallest member that each reaches."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]


def search(prints: np.ndarray, held: np.ndarray, asking: np.ndarray, bits: int, found, pairs: int = PAIRS, skipped: int = 0) -> None:
    """Call found(held, asking) with the numbers of all pairs that link. Held ones are parted by their distance to one of them; only what
    lies within `bits` of a ring asks there, until few pairs are left or vantage points no longer part them."""
    if not len(held) or not len(asking):
        return
    if len(held) * len(asking) <= pairs // 16 or skipped > 3:
        for start in range(0, len(asking), max(1, pairs // len(held))):
            some = asking[start:start + max(1, pairs // len(held))]
            a, b = np.nonzero(np.bitwise_count(prints[held][:, None] ^ prints[some][None, :]) <= bits)
            found(held[a], some[b])
        return
    point = prints[held[len(held) // 2]]
    at, asked = (np.bitwise_count(prints[x] ^ point).astype(np.int16) for x in (held, asking))
    for d in np.unique(at):
        ring_held, near = held[at == d], asking[np.abs(asked - d) <= bits]
        worse = 2 * len(ring_held) * len(near) > len(held) * len(asking)
        search(prints, ring_held, near, bits, found, pairs, skipped + 1 if worse else 0)


def _leaf_links(bits):
    """Links that connect what is connected in a shard."""
    def links(table: pa.Table) -> pa.Table:
        prints = table.column("print").to_numpy().view(np.uint64)
        home, every = table.column("home").to_numpy().astype(bool), np.arange(len(prints))
        joined = Joined(len(prints))
        search(prints, np.flatnonzero(home), every, bits, joined.add)
        b = np.flatnonzero(joined.root != every)
        return pa.table([pa.array(prints[x].view(np.int64)) for x in (joined.root[b], b)], names=["a", "b"])
    return links


def links(prints: DataFrame, bits: int = BITS, leaf: int = LEAF) -> DataFrame:
    """(a, b): links between distinct fingerprints (print), enough of them to connect all that are connected."""
    vantage = (prints.agg(F.min_by("print", F.struct(F.xxhash64("print"), "print"))).first()[0] or 0) % 2**64
    rows = prints.select(F.lit(b"").alias("cell"), "print", F.lit(True).alias("home"))
    found, stretches = None, 1
    while True:
        rows = cut(rows.mapInArrow(_split(vantage, stretches, bits), "cell binary, print long, home boolean"), "simhash-shards")
        sizes = cut(rows.groupBy("cell").agg(F.count_if("home").alias("held"), F.count_if(~F.col("home")).alias("asking")).where("held > 0"), "simhash-sizes")
        # On the last level a shard holds one fingerprint.
        done = sizes.where(F.lit(stretches == 64) | (F.col("held") <= leaf)).where("held + asking > 1")
        shares = done.select("cell", F.greatest(F.lit(1), F.ceil(F.col("asking") / QUERIES)).cast("int").alias("shares"))
        share = F.when(F.col("home"), F.sequence(F.lit(0), F.col("shares") - 1)).otherwise(F.array(F.pmod(F.xxhash64("print"), "shares").cast("int")))
        dealt = rows.join(shares, "cell").select("cell", "print", "home", F.explode(share).alias("share"))
        part = cut(dealt.groupBy("cell", "share").applyInArrow(_leaf_links(bits), "a long, b long"), "simhash-links")
        found = part if found is None else found.unionByName(part)
        large = sizes.where(F.col("held") > leaf).select("cell")
        if stretches == 64 or not large.head(1):
            return found
        rows = rows.join(large, "cell", "left_semi")
        stretches *= 2


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, bits: int = BITS, leaf: int = LEAF) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row for each row."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = cut(rows.mapInArrow(_signed(size), "doc_id long, print long"), "simhash-prints")
    classes = cut(signed.where("doc_id IS NOT NULL").groupBy("print").agg(F.min("doc_id").alias("least")), "simhash-classes")
    member = cut(classes.join(components(links(classes.select("print"), bits, leaf)), F.col("print") == F.col("node"), "left")
                 .select("print", "least", F.coalesce("component", "print").alias("component")), "simhash-members")
    named = member.groupBy("component").agg(F.min("least").alias("component_id"))
    named = cut(member.join(named, "component").select(F.col("print").alias("of"), "component_id"), "simhash-components")
    return signed.join(named, F.col("print") == F.col("of"), "left").select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
