"""Benchmark decontamination by a prefix-filtered join of word shingles.

An item's windows are its runs of WINDOW consecutive words; a shorter item is one window. A window can only occur in a document that
holds all its shingles, so one shingle, the rarest over all documents, is the whole prefix that must be joined. Three jobs:

1. occurrences of the items' shingles are counted over all documents, with sums per task before the shuffle;
2. each window keeps its rarest shingle and the place it has in the window;
3. documents look up their shingles among the kept ones; a hit fixes where the window would start, which must lie within the document
   (positional and length bounds), and the words there are compared one by one.

The items are the query set; their windows are taken in blocks of at most BLOCK rows, which is all that is broadcast at once, and a
larger benchmark takes more blocks, one after the other in the same pass over the documents. Documents are never shuffled.

Null and wordless texts have no words, no hits and no items; wordless items never occur; items may repeat their id or text, and each id
counts once; a null id is the empty one. Texts are compared whole, whatever their length. Empty tables give no rows, or documents without hits.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.tables import cut, pieces, texts_of, whole_row

WINDOW = 10
SHINGLE = 3
#: Most (item, window) rows of a block, which the driver and each task hold; a row takes some 300 bytes.
BLOCK = 1 << 16

#: Lower case for A-Z, a space for all ASCII that is neither letter nor digit; UTF-8 bytes above stay.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))

ITEM_TYPE = "item string, words array<binary>"


def words(text) -> list[bytes]:
    """Words of a text as lower-case UTF-8."""
    return (text if isinstance(text, bytes) else (text or "").encode()).translate(_TABLE).split(b" ") if text else []


def tokens(text) -> list[bytes]:
    return [w for w in words(text) if w]


def windows_of(item: list[bytes], size: int = WINDOW) -> list[tuple]:
    return [tuple(item[i:i + size]) for i in range(max(1, len(item) - size + 1))] if item else []


class Block:
    """The windows of one block in arrays: words by number, shingles by the numbers of their words."""

    def __init__(self, windows: list[tuple], owners: list[str]):
        self.number = {}
        for w in windows:
            for x in w:
                self.number.setdefault(x, len(self.number))
        self.windows, self.owners = windows, owners
        self.lengths = np.array([len(w) for w in windows], np.int64)
        self.table = np.full((len(windows), max(map(len, windows), default=0)), -1, np.int64)
        for i, w in enumerate(windows):
            self.table[i, :len(w)] = [self.number[x] for x in w]

    def keys(self, ids: np.ndarray, k: int) -> np.ndarray:
        """Numbers of the runs of k words, -1 where a word is in no window."""
        if len(ids) < k:
            return np.empty(0, np.int64)
        out, known = np.zeros(len(ids) - k + 1, np.int64), np.ones(len(ids) - k + 1, bool)
        for i in range(k):
            part = ids[i:len(ids) - k + 1 + i]
            out = out * (len(self.number) + 1) + part + 1
            known &= part >= 0
        return np.where(known, out, -1)

    def ids(self, found: list[bytes]) -> np.ndarray:
        get = self.number.get
        return np.array([get(w, -1) for w in found], np.int64)

    def shingles(self):
        """For each size of shingle: (windows, place in the window, key) of all shingles."""
        sizes = np.minimum(self.lengths, SHINGLE)
        for k in np.unique(sizes):
            rows = np.flatnonzero(sizes == k)
            made = [(np.full(self.lengths[r] - k + 1, r), np.arange(self.lengths[r] - k + 1), self.keys(self.table[r, :self.lengths[r]], int(k))) for r in rows]
            yield int(k), *(np.concatenate(x) for x in zip(*made))


def _windows(size):
    """Rows (item, words) of the windows of a batch of items; a text's repeated window counts once."""
    def cut_items(batches):
        for batch in batches:
            pairs = [(item, w) for item, text in zip(batch.column("item").to_pylist(), texts_of(batch, "text")) for w in dict.fromkeys(windows_of(tokens(text), size))]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in pairs], pa.string()), pa.array([list(w) for _, w in pairs], pa.list_(pa.binary()))], names=["item", "words"])
    return cut_items


def _counter(held, text):
    """Occurrences of the block's shingles in the documents of a task, as (size, key, n)."""
    def count(batches):
        block = Block(*held.value)
        sums = {k: (u := np.unique(keys), np.zeros(len(u), np.int64)) for k, _, _, keys in block.shingles()}
        for batch in pieces(batches):
            for value in texts_of(batch, text):
                ids = block.ids(tokens(value))
                for k, (known, n) in sums.items():
                    at = block.keys(ids, k)
                    at = at[at >= 0]
                    i = np.minimum(np.searchsorted(known, at), len(known) - 1)
                    np.add.at(n, i[known[i] == at], 1)
        for k, (known, n) in sums.items():
            some = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(np.full(some.sum(), k), pa.int32()), pa.array(known[some]), pa.array(n[some])], names=["size", "key", "n"])
    return count


class Finder:
    """Occurrences of one block's windows through their rarest shingle."""

    def __init__(self, block: Block, counts: dict):
        self.block, self.by_size = block, {}
        for k, rows, places, keys in block.shingles():
            n = np.array([counts.get((k, int(x)), 0) for x in keys], np.int64)
            order = np.lexsort((places, keys, n, rows))
            first = order[np.concatenate(([True], rows[order][1:] != rows[order][:-1]))]
            # Windows with a shingle that no document has cannot occur.
            first = first[n[first] > 0]
            order = first[np.argsort(keys[first], kind="stable")]
            self.by_size[k] = keys[order], rows[order], places[order]

    def find(self, found: list[bytes]):
        """(window, start) of every occurrence."""
        ids = self.block.ids(found)
        out = []
        for k, (known, rows, places) in self.by_size.items():
            at = self.block.keys(ids, k)
            place = np.flatnonzero(at >= 0)
            low, high = np.searchsorted(known, at[place], "left"), np.searchsorted(known, at[place], "right")
            times = high - low
            if not times.sum():
                continue
            begin = np.repeat(place, times)
            which = np.repeat(low - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(times.sum())
            window, start = rows[which], begin - places[which]
            length = self.block.lengths[window]
            inside = (start >= 0) & (start + length <= len(ids))
            window, start = window[inside], start[inside]
            for n in np.unique(self.block.lengths[window]):
                some = self.block.lengths[window] == n
                w, s = window[some], start[some]
                # Compared in parts, so that a text full of hits needs little memory.
                for i in range(0, len(w), 1 << 16):
                    same = (ids[s[i:i + (1 << 16), None] + np.arange(n)] == self.block.table[w[i:i + (1 << 16)], :n]).all(1)
                    out.append((w[i:i + (1 << 16)][same], s[i:i + (1 << 16)][same]))
        if not out:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*out))


def _scanner(held, path):
    """Add one block's hits to what the blocks before have found: covered ranges of words, and items."""
    def scan(batches):
        block = Block(*held.value[:2])
        finder = Finder(block, held.value[2])
        for batch in pieces(batches):
            sizes, spans, lists = [], [], []
            for value, before, items in zip(texts_of(batch, *path), batch.column("spans").to_pylist(), batch.column("items").to_pylist()):
                found = tokens(value)
                window, start = finder.find(found)
                if len(window):
                    edges = np.zeros(len(found) + 1, np.int64)
                    np.add.at(edges, start, 1)
                    np.add.at(edges, start + block.lengths[window], -1)
                    for s, e in zip(before[::2], before[1::2]):
                        edges[s] += 1
                        edges[e] -= 1
                    covered = np.concatenate(([0], np.cumsum(edges) > 0)).astype(np.int8)
                    before = np.flatnonzero(np.diff(covered)).tolist()
                    items = sorted({*items, *(block.owners[w] for w in np.unique(window))})
                sizes.append(len(found))
                spans.append(before)
                lists.append(items)
            made = {"n_words": pa.array(sizes, pa.int64()), "spans": pa.array(spans, pa.list_(pa.int64())), "items": pa.array(lists, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([made.get(n, batch.column(i)) for i, n in enumerate(batch.schema.names)], names=batch.schema.names)
    return scan


def find_items(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
               block: int = BLOCK) -> DataFrame:
    """All rows and columns of docs with n_words, spans (starts and ends of the hit runs of words, in turn) and items (ids as strings)."""
    return _found(docs, benchmark, (text,), item_id, item_text, window, block)


def _found(docs, benchmark, path, item_id="item_id", item_text="text", window=WINDOW, block=BLOCK):
    """find_items with the text at a path: a column, or a struct column and its field."""
    spark = docs.sparkSession
    whole = F.col(f"`{path[0]}`")
    for name in path[1:]:
        whole = whole[name]
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("text"))
    windows = cut(items.mapInArrow(_windows(window), ITEM_TYPE).distinct(), "decontam-windows")
    n_blocks = windows.count() // max(1, block // 2) + 1
    found = docs.withColumns({"n_words": F.lit(0).cast("long"), "spans": F.array().cast("array<bigint>"), "items": F.array().cast("array<string>")})
    for b in range(n_blocks):
        rows = windows.where(F.pmod(F.xxhash64("item", "words"), F.lit(n_blocks)) == b).collect()
        held = [tuple(bytes(x) for x in r["words"]) for r in rows], [r["item"] for r in rows]
        counted = docs.select(whole.alias("text")).mapInArrow(_counter(spark.sparkContext.broadcast(held), "text"), "size int, key long, n long")
        counts = {(r["size"], r["key"]): r["n"] for r in counted.groupBy("size", "key").agg(F.sum("n").alias("n")).collect()}
        found = found.mapInArrow(_scanner(spark.sparkContext.broadcast((*held, counts)), path), found.schema)
    return found


def hits(spans) -> "F.Column":
    """Words in runs given by starts and ends in turn."""
    return F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)


def report(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_items(docs.select("doc_id", "text"), benchmark, **settings).withColumn("n_hit", hits(F.col("spans")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The documents in which no window occurs, with their columns."""
    held = docs.select(whole_row(docs).alias("row"))
    return _found(held, benchmark, ("row", "text"), **settings).where(F.size("spans") == 0).select("row.*")
