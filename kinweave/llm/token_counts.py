"""Token counts under a unigram model of a public vocabulary, with one forward pass per shared prefix.

A text is cut into pre-tokens. The best split of a pre-token into pieces has the highest sum of piece scores, the fewest pieces among
equals. The forward score of a prefix depends on the prefix alone, so each task keeps a trie of the distinct pre-tokens it has met: a node
holds the best score and piece count of its prefix, is computed once from its ancestors, and the node where a pre-token ends has
its count. The trie is begun anew when it has NODES nodes, which bounds memory and changes no count. Texts are not shuffled.

The vocabulary is a file of base64 pieces and ranks that is read on the driver and broadcast (its size is fixed by the file); it must hold
all single bytes. Scores are log-probabilities of Zipf's law in the order of ranks. Pre-tokens longer than LONG bytes are scored without
the trie. Null and empty texts have no tokens; repeated rows are counted alike; an empty table gives no rows.
"""
import base64
import math
from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern that belongs to the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NODES = 1 << 20
LONG = 256


def zipf_scores(path: str = VOCABULARY) -> dict:
    """Piece -> log-probability by rank."""
    with open(path, "rb") as f:
        ranked = sorted((int(rank), base64.b64decode(piece)) for piece, rank in (line.split() for line in f if line.strip()))
    total = math.log(sum(1 / (i + 1) for i in range(len(ranked))))
    scores = {piece: -math.log(i + 1) - total for i, (_, piece) in enumerate(ranked)}
    missing = [b for b in range(256) if bytes([b]) not in scores]
    if missing:
        raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
    return scores


def best_split(word: bytes, scores: dict, longest: int) -> int:
    """Pieces of the best split, by a pass of its own."""
    best, count = [0.0], [0]
    for end in range(1, len(word) + 1):
        top, n = -math.inf, 0
        for size in range(1, min(end, longest) + 1):
            s = scores.get(word[end - size:end])
            if s is not None and ((v := best[end - size] + s) > top or v == top and count[end - size] + 1 < n):
                top, n = v, count[end - size] + 1
        best.append(top)
        count.append(n)
    return count[-1]


class Trie:
    """Forward scores of prefixes. Children are found by (node, byte); node 0 is the empty prefix."""

    def __init__(self, scores: dict, most: int = NODES):
        self.scores, self.most, self.longest = scores, most, max(map(len, scores))
        # All ends of pieces: where the end of a prefix is none of them, no longer piece can end there.
        self.tails = {piece[i:]: None for piece in scores for i in range(len(piece))} | scores
        self.clear()

    def clear(self):
        self.child, self.best, self.pieces, self.ends = {}, [0.0], [0], {}

    def count(self, pretoken: str) -> int:
        known = self.ends.get(pretoken)
        if known is not None:
            return known
        word = pretoken.encode()
        if len(word) > LONG:
            return best_split(word, self.scores, self.longest)
        if len(self.best) > self.most:
            self.clear()
        path, node = [0], 0
        child, best, pieces, tails = self.child, self.best, self.pieces, self.tails
        for end, byte in enumerate(word, 1):
            key = node << 8 | byte
            node = child.get(key)
            if node is None:
                top, n = -math.inf, 0
                for start in range(end - 1, -1, -1):
                    s = tails.get(word[start:end], self)
                    if s is self:
                        break
                    if s is not None:
                        at = path[start]
                        v = best[at] + s
                        if v > top or v == top and pieces[at] + 1 < n:
                            top, n = v, pieces[at] + 1
                node = child[key] = len(best)
                best.append(top)
                pieces.append(n)
            path.append(node)
        self.ends[pretoken] = pieces[node]
        return pieces[node]


def _counter(held, pattern, most):
    def count(batches):
        trie, cut_text = Trie(held.value, most), regex.compile(pattern)
        for batch in batches:
            made = []
            for text in batch.column("text").to_pylist():
                words = Counter(cut_text.findall(text)) if text else {}
                made.append((words and sum(words.values()) or 0, sum(n * trie.count(w) for w, n in words.items()), len(text.encode()) if text else 0))
            cols = list(zip(*made)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(cols[i], pa.int64()) for i in (2, 0, 1)]], names=["doc_id", "n_bytes", "n_pretokens", "n_tokens"])
    return count


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, nodes: int = NODES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_pretokens, n_tokens."""
    held = docs.sparkSession.sparkContext.broadcast(zipf_scores(vocabulary))
    rows = docs.selectExpr(f"cast(`{key}` as long) as doc_id", f"`{text}` as text")
    return rows.mapInArrow(_counter(held, pattern, nodes), "doc_id long, n_bytes long, n_pretokens long, n_tokens long")
