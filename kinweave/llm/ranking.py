"""Ranked lexical search over an index that is stratified by document length.

A document's length enters its score only through the whole number m, so documents of equal m form a stratum, and in a stratum all
postings of equal tf have the same impact. The index holds the documents in order of m, ranged into parts of like size (a stratum that many
documents share spans several). A task reads its part once, in windows of bounded size: it orders the postings of each stratum by term and tf, computes the
impact once per tf, and bounds what an item can score in a stratum by the impacts of the largest tf of its terms. Strata are visited
from the highest bound down, and only for the items whose bound reaches the item's score at the last place so far. Each task returns the best
of each item, which Spark merges.

Counts are of all documents: one pass over the texts writes the number of terms of every document and its postings of such terms
as may occur in an item (a bitmap of fixed size says which; a few others pass and are ignored). Items are searched in blocks of about
BLOCK_ITEMS items and BLOCK_TERMS terms, which bounds what is broadcast; a further block reads the index again, not the texts.

Rows of items with the same id are one item with the terms of their distinct texts; a null id is such an id too. Every row of documents
is a document: repeated rows take a place each, null ids come last among equal scores. Null and wordless texts have no terms: they are
neither counted nor found, and such items find nothing. Texts are taken whole, whatever their length. Empty tables give no rows; other
columns are not touched.
"""
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.tables import cut, shards_of

BEST = 20
PLACES = 1 << 20
BLOCK_ITEMS, BLOCK_TERMS = 1024, 1 << 17
#: Bounds of a window of the index, and of the scores added at once.
WINDOW_DOCS, WINDOW_POSTINGS, ADDED = 4096, 1 << 18, 1 << 20
#: Constants of the weights, impacts and lengths.
SCALE, K_TF, K_M, BASE, SLOPE = 1_000_000_000, 1000, 12, 100, 25

#: Everything in ASCII that is not a letter or digit becomes a space, A-Z become small; other bytes are parts of letters.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def place(term: bytes) -> int:
    return xxhash.xxh3_64_intdigest(term) % PLACES


def _item_terms(batches):
    for batch in batches:
        rows = [(i, t.decode(), n, place(t)) for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()) for t, n in Counter(terms(text)).items()]
        at, words, counts, places = map(list, zip(*rows)) if rows else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(at, pa.int64())), pa.array(words, pa.string()), pa.array(counts, pa.int64()), pa.array(places, pa.int32())],
                                         names=["item_id", "term", "times", "place"])


class _Wanted(dict):
    """Whether a term may occur in an item, kept while there are few."""

    def __init__(self, bitmap: bytes):
        self.bitmap = bitmap

    def __missing__(self, term):
        if len(self) > 1 << 18:
            self.clear()
        at = place(term)
        self[term] = found = self.bitmap[at >> 3] >> (at & 7) & 1
        return found


def _postings(shared):
    def post(batches):
        wanted = _Wanted(shared.value)
        for batch in batches:
            n, words, counts, ends = [], [], [], [0]
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                found = terms(text)
                n.append(len(found))
                for term, tf in Counter(found).items():
                    if wanted[term]:
                        words.append(term)
                        counts.append(tf)
                ends.append(len(words))
            ends = pa.array(ends, pa.int32())
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(words, pa.binary()).cast(pa.string())),
                                              pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64()))], names=["doc_id", "n", "terms", "tfs"])
            yield out.filter(pc.greater(out.column("n"), 0))
    return post


class Items:
    """A block of items: for each term the items that hold it, with weight times occurrences."""

    def __init__(self, held: pa.Table):
        term = pc.dictionary_encode(held.column("term").combine_chunks())
        self.vocabulary, codes = term.dictionary, term.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        self.item = held.column("item").to_numpy()[order].astype(np.int64)
        self.gain = held.column("gain").to_numpy()[order].astype(np.int64)
        self.start = np.searchsorted(codes[order], np.arange(len(self.vocabulary) + 1))
        self.n = int(self.item.max()) + 1 if len(self.item) else 0

    def spread(self, term: np.ndarray):
        """Pieces (at, entry): each position of `term` with each entry of its term."""
        count = self.start[term + 1] - self.start[term]
        total = np.concatenate([[0], np.cumsum(count)])
        i = 0
        while i < len(term):
            j = max(i + 1, int(np.searchsorted(total, total[i] + ADDED, "right")) - 1)
            at = np.repeat(np.arange(i, j), count[i:j])
            yield at, np.arange(total[j] - total[i]) - (total[at] - total[i]) + self.start[term[at]]
            i = j

    def scored(self, row: np.ndarray, term: np.ndarray, impact: np.ndarray, rows: int, live=None) -> np.ndarray:
        """Sums of gain * impact by row and item, for live items."""
        out = np.zeros(rows * self.n, np.int64)
        for at, entry in self.spread(term):
            if live is not None:
                keep = live[self.item[entry]]
                at, entry = at[keep], entry[keep]
            np.add.at(out, row[at] * self.n + self.item[entry], self.gain[entry] * impact[at])
        return out.reshape(rows, self.n)


class Best:
    """The best documents of each item so far."""

    def __init__(self, items: int, best: int):
        self.best, self.last = best, np.ones(items, np.int64)
        self.item, self.doc, self.score = (np.empty(0, np.int64) for _ in range(3))
        self.named = np.empty(0, bool)

    def add(self, item, doc, named, score) -> None:
        item, doc, named, score = (np.concatenate(p) for p in ((self.item, item), (self.doc, doc), (self.named, named), (self.score, score)))
        order = np.lexsort((doc, ~named, -score, item))
        item = item[order]
        first = np.searchsorted(item, item, "left")
        keep = order[np.arange(len(order)) - first < self.best]
        item, doc, named, score = (a for a in (item[np.arange(len(order)) - first < self.best], doc[keep], named[keep], score[keep]))
        self.item, self.doc, self.named, self.score = item, doc, named, score
        full = np.flatnonzero(np.bincount(item, minlength=len(self.last)) == self.best)
        self.last[full] = score[np.searchsorted(item, full, "right") - 1]


def _strata(found: Best, items: Items, docs, named, m, row, term, tf) -> None:
    """Visit the strata of a window. row, term, tf: postings; docs, named, m: by row."""
    if not len(row):
        return
    order = np.lexsort((tf, term, m[row]))
    row, term, tf = row[order], term[order], tf[order]
    heights, stratum = np.unique(m[row], return_inverse=True)
    # One impact for each tf of a stratum.
    kinds, kind = np.unique(stratum * (int(tf.max()) + 1) + tf, return_inverse=True)
    times = kinds % (int(tf.max()) + 1)
    impact = (SCALE * times // (K_TF * times + K_M * heights[kinds // (int(tf.max()) + 1)]))[kind]
    # Postings of a term end with its largest tf.
    ends = np.flatnonzero(np.concatenate([(stratum[1:] != stratum[:-1]) | (term[1:] != term[:-1]), [True]]))
    bounds = items.scored(stratum[ends], term[ends], impact[ends], len(heights))
    start = np.searchsorted(stratum, np.arange(len(heights) + 1))
    for s in np.argsort(-bounds.max(1), kind="stable"):
        live = bounds[s] >= found.last
        if not live.any():
            continue
        part = slice(start[s], start[s + 1])
        members, at = np.unique(row[part], return_inverse=True)
        scores = items.scored(at, term[part], impact[part], len(members), live)
        r, item = np.nonzero(scores >= np.maximum(found.last, 1))
        found.add(item, docs[members[r]], named[members[r]], scores[r, item])


def _searched(shared, best):
    def search(batches):
        items = shared.value
        found, held, docs, postings = Best(items.n, best), [], 0, 0

        def visit():
            window = pa.Table.from_batches(held)
            flat = window.column("terms").combine_chunks()
            row = np.repeat(np.arange(len(window)), pc.list_value_length(flat).to_numpy())
            term = pc.index_in(flat.flatten(), items.vocabulary)
            tf = window.column("tfs").combine_chunks().flatten().to_numpy()
            known = term.is_valid().to_numpy(zero_copy_only=False)
            ids = window.column("doc_id")
            _strata(found, items, ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(), window.column("m").to_numpy(),
                    row[known], term.fill_null(0).to_numpy()[known].astype(np.int64), tf[known])

        for batch in batches:
            sizes = np.cumsum(np.concatenate([[0], pc.list_value_length(batch.column("terms")).to_numpy()]))
            i = 0
            while i < batch.num_rows:
                room = int(np.searchsorted(sizes, sizes[i] + max(0, WINDOW_POSTINGS - postings), "right")) - 1
                j = min(batch.num_rows, i + WINDOW_DOCS - docs, max(room, i if held else i + 1))
                if j > i:
                    held.append(batch.slice(i, j - i))
                    docs, postings = docs + j - i, postings + int(sizes[j] - sizes[i])
                if j < batch.num_rows:
                    visit()
                    held, docs, postings = [], 0, 0
                i = j
        if held:
            visit()
        yield pa.RecordBatch.from_arrays([pa.array(found.item.astype(np.int32)), pa.array(found.doc, mask=~found.named), pa.array(found.score)], names=["item", "doc_id", "score"])
    return search


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, term, times, place): the terms of each item with their repeats."""
    rows = items.select(F.col(key).alias("item_id"), F.col(text).alias("text")).distinct()
    kind = rows.schema["item_id"].dataType.simpleString()
    made = rows.mapInArrow(_item_terms, f"item_id {kind}, term string, times long, place int")
    return cut(made.groupBy("item_id", "term", "place").agg(F.sum("times").alias("times")), "ranking-items")


def index(docs: DataFrame, wanted: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, int, DataFrame]:
    """(index of doc_id, m, terms, tfs in order of m; number of documents with terms; df of the wanted terms)."""
    bitmap = np.zeros(PLACES, np.uint8)
    # At most PLACES numbers.
    bitmap[[r.place for r in wanted.select("place").distinct().collect()]] = 1
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bitmap, bitorder="little").tobytes())
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    posted = cut(rows.mapInArrow(_postings(shared), "doc_id long, n long, terms array<string>, tfs array<long>"), "ranking-postings")
    count, length = posted.agg(F.count("*"), F.sum("n")).first()
    counts = posted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    counts = cut(counts.join(wanted.select("term").distinct(), "term", "left_semi"), "ranking-df")
    m = F.expr(f"{BASE - SLOPE}L + ({SLOPE}L * n * {count}L) div {length or 1}L")
    ranged = (posted.where(F.size("terms") > 0).select("doc_id", m.alias("m"), "terms", "tfs")
              .repartitionByRange(shards_of(docs), "m", F.xxhash64("doc_id", "terms")).sortWithinPartitions("m"))
    return cut(ranged, "ranking-index"), count, counts


def search(docs: DataFrame, items: DataFrame, best: int = BEST, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
           block_items: int = BLOCK_ITEMS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the best documents of each item."""
    spark = docs.sparkSession
    wanted = item_terms(items, item_key, item_text)
    held, count, counts = index(docs, wanted, key, text)
    gain = F.floor(1000 * F.log((F.lit(2.0) * count + 2) / (2 * F.col("df") + 1))) * F.col("times")
    weighed = wanted.join(counts, "term").select("item_id", "term", gain.cast("long").alias("gain"))
    n_terms, n_items = wanted.agg(F.count("*"), F.count_distinct(F.struct("item_id"))).first()
    blocks = max(1, -(-n_terms // block_terms), -(-n_items // block_items))
    weighed = cut(weighed.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int")), "ranking-weights")
    out = None
    for b in range(blocks):
        # About block_items rows, and as many broadcast.
        names = [r.item_id for r in weighed.where(F.col("block") == b).select("item_id").distinct().collect()]
        numbered = spark.createDataFrame(list(enumerate(names)), f"item int, item_id {weighed.schema['item_id'].dataType.simpleString()}")
        table = weighed.where(F.col("block") == b).withColumnRenamed("item_id", "of").join(F.broadcast(numbered), F.col("of").eqNullSafe(F.col("item_id"))).select("item", "term", "gain").toArrow()
        shared = spark.sparkContext.broadcast(Items(table))
        found = held.mapInArrow(_searched(shared, best), "item int, doc_id long, score long")
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        part = found.withColumn("rank", rank).where(F.col("rank") <= best).join(F.broadcast(numbered), "item").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return out


def search_sql(best: int = BEST) -> str:
    """DuckDB SQL for the same rows of the tables documents and benchmark (distinct item ids)."""
    split = f"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{PATTERN}'))"
    return f"""WITH words AS (SELECT r, doc_id, {split} AS term FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)),
asked AS MATERIALIZED (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {split} AS term FROM benchmark) GROUP BY ALL),
tf AS MATERIALIZED (SELECT r, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
doc AS MATERIALIZED (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r),
total AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM doc),
norm AS MATERIALIZED (SELECT r, {BASE - SLOPE} + ({SLOPE} * n * n_docs) // n_terms AS m FROM doc, total),
weight AS MATERIALIZED (SELECT term, floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, n_docs),
scored AS (SELECT a.item_id, t.r, t.doc_id, sum(a.times * w * (({SCALE} * tf) // ({K_TF} * tf + {K_M} * m)))::BIGINT AS score
  FROM tf t JOIN asked a USING (term) JOIN weight USING (term) JOIN norm USING (r) GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= {best}"""
