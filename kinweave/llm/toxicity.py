"""Toxicity by two Kneser-Ney models, one of toxic and one of ordinary text.

A document's evidence is the difference of its log-likelihoods under the two bigram models, divided by its words. Both models discount
every count and back off to counts that the classes share: from the documents of the class that hold a word pair to those of both
classes, then to the documents of the class that hold the word, and from there to the documents of the whole corpus that hold it
(documents are the contexts that are counted, so a long or repetitive text weighs no more than another). A word that neither class knows is therefore as likely
under both, and a rare one moves the score little. A logistic curve on evidence and length turns the difference into a probability.

Bounds: the models are fitted on at most SAMPLE labelled rows of each class, the first in the order of a hash of the id; they keep
the WORDS most frequent words and PAIRS most frequent pairs of those in more documents of a class than the discount. Only these tables are collected and broadcast.
The curve is fitted on the same rows, each scored by models without its own fold; equal texts share a fold. The shared counts cover
all documents, and every document is scored whole.

Labels count only where crc32(doc_id as text) mod 4 is not 2. An id labelled twice takes the larger label; null labels and null ids
are ignored. Null and empty texts have no evidence. Repeated rows are counted as often as they occur and scored alike. Without
labels of both classes the score is the share of toxic labels (0 without any). Empty tables give no rows.
"""
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from kinweave.llm.decontamination import tokens
from kinweave.llm.tables import cut, pieces, texts_of, whole_row

SAMPLE = 10_000
WORDS = 1 << 16
PAIRS = 1 << 17
FOLDS = 4
#: Counts that a task gathers before it passes them on.
FLUSH = 1 << 17
#: Taken from every count: what was seen so rarely is left to the counts that the classes share.
DISCOUNT = 5.0
#: A word or pair whose difference is above this is strong evidence by itself.
STRONG = 1.5
#: Part of the shared pair model that is left to single words.
SHARE = 0.5
THRESHOLD = 0.3

CELLS = [f"n_{label}{fold}" for label in (0, 1) for fold in range(FOLDS)]


def held_out(key):
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def training_labels(labels: DataFrame, key: str = "doc_id", label: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """key, label: at most `sample` rows of each class."""
    usable = (labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col(key)))
              .groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("int").alias("_label")))
    parts = [usable.where(F.col("_label") == c).orderBy(F.xxhash64("_key"), "_key").limit(sample) for c in (0, 1)]
    return cut(parts[0].unionByName(parts[1]), "toxic-labels")


def _examples(batch):
    return zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("_label").to_pylist(), batch.column("_fold").to_pylist())


def _count_words(batches):
    """(word, label, fold, n): documents of a task that hold a word, in pieces of bounded size."""
    def rows(sums):
        flat = [(w, label, fold, n) for (label, fold), c in sums.items() for w, n in c.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*flat), (pa.binary(), pa.int32(), pa.int32(), pa.int64()))], names=["word", "label", "fold", "n"])
    sums = {}
    for batch in batches:
        for text, label, fold in _examples(batch):
            sums.setdefault((label, fold), Counter()).update(set(tokens(text)))
            if sum(map(len, sums.values())) > FLUSH:
                yield rows(sums)
                sums = {}
    if any(sums.values()):
        yield rows(sums)


def _count_pairs(held):
    """(pair, label, fold, n): documents of a task that hold a pair; a text begins after an empty word, and all words that the model does
    not keep are one as the second of a pair."""
    def count(batches):
        number = {w: i for i, w in enumerate(held.value)}
        size = len(number) + 1

        def rows(keys):
            found, n = np.unique(np.concatenate(keys), return_counts=True)
            pair, cell = found // (2 * FOLDS), found % (2 * FOLDS)
            return pa.RecordBatch.from_arrays([pa.array(pair), pa.array((cell // FOLDS).astype(np.int32)), pa.array((cell % FOLDS).astype(np.int32)), pa.array(n.astype(np.int64))],
                                              names=["pair", "label", "fold", "n"])
        keys = []
        for batch in batches:
            for text, label, fold in _examples(batch):
                found = tokens(text)
                w = np.fromiter((number.get(x, size - 1) for x in found), np.int64, len(found))
                v = np.concatenate(([number[b""]], w[:-1])) if found else w
                keys.append(np.unique((v * size + w)[v < size - 1]) * (2 * FOLDS) + label * FOLDS + fold)
                if len(keys) % 64 == 0 and sum(map(len, keys)) > FLUSH:
                    yield rows(keys)
                    keys = []
        if keys:
            yield rows(keys)
    return count


def _cells():
    """Sums by label and fold."""
    at = lambda c, f: (F.col("label") == c) & (F.col("fold") == f)
    return [F.sum(F.when(at(c, f), F.col("n")).otherwise(0)).alias(f"n_{c}{f}") for c in (0, 1) for f in range(FOLDS)]


def _cube(table) -> np.ndarray:
    """(rows, labels, folds) of a collected table."""
    return np.stack([np.stack([table.column(f"n_{c}{f}").to_numpy(zero_copy_only=False) for f in range(FOLDS)], 1) for c in (0, 1)], 1).astype(float)


@dataclass
class Model:
    """Collected counts. Words and pairs are in sorted order; a pair is before * len(words) + word."""
    words: list = field(default_factory=list)
    n_word: np.ndarray = None  # documents that hold it, by label and fold
    begun: np.ndarray = None  # its pairs as the first word, each counted once a document
    pairs: np.ndarray = None
    n: np.ndarray = None
    n_all: np.ndarray = None  # sum of n_word over all words, also those not kept
    shared: np.ndarray = None
    curve: np.ndarray = None
    rate: float = 0.0

    def numbers(self):
        return {w: i for i, w in enumerate(self.words)}

    def tables(self, fold=None):
        """Differences of log-likelihood, toxic less ordinary: of words, of kept pairs, and of what contexts leave to words; without one fold."""
        part = (lambda x: x.sum(-1)) if fold is None else (lambda x: x.sum(-1) - x[..., fold])
        above = lambda x: np.maximum(x - DISCOUNT, 0)
        log = lambda x: np.log(x[:, 1]) - np.log(x[:, 0])
        total = np.maximum(part(self.n_all), 1)
        own = above(part(self.n_word)) / total
        left = 1 - own.sum(0)
        low = own + left * self.shared[:, None]
        v, w = self.pairs // max(1, len(self.words)), self.pairs % max(1, len(self.words))
        n, begun = part(self.n), np.maximum(part(self.begun), 1)
        own = above(n) / begun[v]
        weight = np.ones_like(begun)
        np.subtract.at(weight, v, own)
        common = above(n.sum(1)) / begun.sum(1)[v]
        high = own + weight[v] * ((1 - SHARE) * common[:, None] + SHARE * low[w])
        return log(low), log(high), log(weight), float(np.log(left[1]) - np.log(left[0]))

    def evidence(self, found: list, number: dict, tables) -> tuple:
        """Sum of the differences over the words of a text, of what is above STRONG in them, and the number of words."""
        if not found:
            return 0.0, 0.0, 0
        low, high, weight, unseen = tables
        get = number.get
        w = np.array([get(x, -1) for x in found], np.int64)
        v = np.concatenate(([number.get(b"", -1)], w[:-1]))
        one = np.where(w >= 0, low[w] if len(low) else 0.0, unseen)
        context = np.where(v >= 0, weight[v] if len(weight) else 0.0, 0.0)
        out = one + context
        if len(self.pairs):
            both = (v >= 0) & (w >= 0)
            key = np.where(both, v * len(self.words) + w, -1)
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            out = np.where(self.pairs[at] == key, high[at], out)
        return float(out.sum()), float(np.maximum(out - STRONG, 0).sum()), len(found)


def features(evidence) -> np.ndarray:
    """Mean evidence, what single strong words bring to it, and the length."""
    total, strong, n = np.asarray(evidence, float).reshape(-1, 3).T
    length = np.maximum(n, 1)
    return np.stack([np.ones_like(n), total / length, np.sqrt(strong / length), strong / np.sqrt(length), np.log1p(n)], 1)


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton steps."""
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + ridge * beta
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(hessian, gradient)
        beta -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _holders(held, text):
    """Documents of a task that hold each word of the model; at -1 the sum over all words."""
    def count(batches):
        number = held.value.numbers()
        n, total = np.zeros(len(number), np.int64), 0
        for batch in pieces(batches):
            for value in texts_of(batch, text):
                held_words = set(tokens(value))
                n[[number[w] for w in held_words if w in number]] += 1
                total += len(held_words)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(n[some], total))], names=["word", "n"])
    return count


def _sampled(held):
    """Cross-fitted evidence of the training rows."""
    def score(batches):
        model = held.value
        number, tables = model.numbers(), [model.tables(f) for f in range(FOLDS)]
        for batch in batches:
            rows = [model.evidence(tokens(t), number, tables[f]) for t, f in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("_fold").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("_label"), pa.array(rows, pa.list_(pa.float64()))], names=["label", "evidence"])
    return score


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, words: int = WORDS, pairs: int = PAIRS) -> Model:
    """The bounded model. Its tables are the only rows that reach the driver."""
    chosen = training_labels(labels, key, sample=sample)
    totals = {r["label"]: r["n"] for r in labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col(key))).groupBy(F.col("toxic").alias("label")).agg(F.count("*").alias("n")).collect()}
    # At most two samples of rows (key, label), so that the texts of the training rows are picked without moving any text.
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("text")).join(F.broadcast(chosen), F.col("_id") == F.col("_key")).select(
        "text", "_label", F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(FOLDS)).cast("int").alias("_fold"))
    # Equal texts of a class are one row of the fit.
    rows = cut(rows.dropDuplicates(["text", "_label"]), "toxic-rows")
    by_word = cut(rows.mapInArrow(_count_words, "word binary, label int, fold int, n long").groupBy("word").agg(*_cells()), "toxic-words")
    # What no class has in more documents than the discount is left to the shared counts anyway.
    usual = F.greatest(*[sum((F.col(f"n_{c}{f}") for f in range(FOLDS)), F.lit(0)) for c in (0, 1)])
    found = by_word.where(usual > DISCOUNT).orderBy(usual.desc(), "word").limit(words).toArrow()
    model = Model(rate=totals.get(1, 0) / max(1, sum(totals.values())), words=sorted([*found.column("word").to_pylist(), b""]))
    number, size = model.numbers(), len(model.words) + 1
    model.n_word = np.zeros((len(number), 2, FOLDS))
    if found.num_rows:
        model.n_word[[number[w] for w in found.column("word").to_pylist()]] = _cube(found)
    model.n_all = _cube(by_word.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in CELLS]).toArrow())[0]
    listed = docs.sparkSession.sparkContext.broadcast(model.words)
    by_pair = cut(rows.mapInArrow(_count_pairs(listed), "pair long, label int, fold int, n long").groupBy("pair").agg(*_cells()), "toxic-pairs")
    first = by_pair.groupBy(F.floor(F.col("pair") / size).alias("first")).agg(*[F.sum(c).alias(c) for c in CELLS]).toArrow()
    model.begun = np.zeros((len(number), 2, FOLDS))
    if first.num_rows:
        model.begun[first.column("first").to_numpy()] = _cube(first)
    double = by_pair.where((usual > DISCOUNT) & (F.col("pair") % size < size - 1)).orderBy(usual.desc(), "pair").limit(pairs).toArrow()
    keys = double.column("pair").to_numpy()
    order = np.argsort(keys)
    model.pairs = (keys // size * (size - 1) + keys % size)[order]
    model.n = _cube(double)[order] if len(keys) else np.zeros((0, 2, FOLDS))
    held = docs.sparkSession.sparkContext.broadcast(model)
    holders = docs.select(text).mapInArrow(_holders(held, text), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    shared = np.full(len(model.words) + 1, 0.5)
    shared[holders.column("word").to_numpy()] += holders.column("n").to_numpy()
    model.shared = shared[:-1] / shared[-1]
    if not (totals.get(0) and totals.get(1)):
        return model
    held = docs.sparkSession.sparkContext.broadcast(model)
    seen = rows.mapInArrow(_sampled(held), "label int, evidence array<double>").toArrow()
    y = seen.column("label").to_numpy().astype(float)
    if y.any() and not y.all():
        share = {c: totals[c] / max(1, (y == c).sum()) for c in (0, 1)}
        weight = np.where(y == 1, share[1], share[0])
        model.curve = fit_curve(features(seen.column("evidence").to_pylist()), y, weight / weight.mean())
    return model


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """(row, score): every row as it is and its probability of being toxic."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        model = held.value
        number = model.numbers()
        tables = model.tables() if model.curve is not None else None
        for batch in pieces(batches):
            texts = texts_of(batch, "row", text)
            if tables is None:
                p = np.full(len(texts), model.rate)
            else:
                x = features([model.evidence(tokens(t), number, tables) for t in texts])
                p = 1 / (1 + np.exp(-np.clip(x @ model.curve, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(p, pa.float64())], names=["row", "score"])
    rows = docs.select(whole_row(docs).alias("row"))
    return rows.mapInArrow(score, StructType([rows.schema["row"], StructField("score", DoubleType())]))


def score_documents(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    found = scored(docs.select("doc_id", "text"), fit(docs, labels, **settings)).select("row.doc_id", "score")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **settings) -> DataFrame:
    """The documents that score below the threshold, with their columns."""
    return scored(docs, fit(docs, labels, **settings)).where(F.col("score") < threshold).select("row.*")
