"""Document fingerprints by quartile bucket digests.

All triplets of neighbouring bytes are hashed into BUCKETS counts. The quartiles of the counts split the buckets into four levels, which
are written with two bits each after the coded length, so a digest has the same size for any text. Two digests differ by the sum of
level steps (a step from end to end weighs more), and by the steps between their lengths; the score is bounded and turned into a
likeness from 0 to 1.

Null is the empty text. Texts of fewer than three bytes have no triplets; they fall into one level and are told apart by their length
only. Equal texts have equal digests wherever they stand. An empty table gives no rows.
"""
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from kinweave.llm.tables import cut, shards_of

BUCKETS = 256
#: Odd multiplier of the triplet hash (2^32 divided by the golden ratio).
SPREAD = np.uint32(2654435769)
#: Cost of level steps 0 to 3, of one step of the coded length, and the score at which two digests have nothing in common.
STEPS = np.array([0, 1, 2, 6])
LENGTH_STEP = 4
BOUND = 2 * BUCKETS


def length_code(n: int) -> int:
    """Steps of a quarter of an octave, 0 for nothing."""
    return min(255, 1 + int(4 * math.log2(n))) if n else 0


def counts(data: bytes) -> np.ndarray:
    """Counts of hashed triplets. A long text is taken in parts, so memory stays bounded."""
    out = np.zeros(BUCKETS, np.int64)
    for i in range(0, max(0, len(data) - 2), 1 << 20):
        b = np.frombuffer(data, np.uint8, min(len(data) - i, (1 << 20) + 2), i).astype(np.uint32)
        key = (b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)) * SPREAD
        out += np.bincount(key >> np.uint32(24), minlength=BUCKETS)
    return out


def digest(data: bytes) -> str:
    """Two hex digits of length, then the levels, four buckets to a byte."""
    n = counts(data)
    ordered = np.sort(n)
    q1, q2, q3 = (ordered[BUCKETS * k // 4 - 1] for k in (1, 2, 3))
    level = (n > q1).astype(np.uint8) + (n > q2) + (n > q3)
    packed = level[0::4] | level[1::4] << 2 | level[2::4] << 4 | level[3::4] << 6
    return f"{length_code(len(data)):02x}" + packed.astype(np.uint8).tobytes().hex()


def _levels(fingerprint: str) -> np.ndarray:
    packed = np.frombuffer(bytes.fromhex(fingerprint[2:]), np.uint8)
    return np.stack([packed >> s & 3 for s in (0, 2, 4, 6)], 1).reshape(-1).astype(np.int64)


def likeness(a: str, b: str) -> float:
    """1 for equal digests, 0 from the bound on."""
    steps = STEPS[np.abs(_levels(a) - _levels(b))].sum()
    score = int(steps) + LENGTH_STEP * abs(int(a[:2], 16) - int(b[:2], 16))
    return 1.0 - min(score, BOUND) / BOUND


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by as many first characters of the following one, or all it has."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                       ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
EDGE_ARROW = OUT_ARROW.append(pa.field("part", pa.int32())).append(pa.field("first", pa.string())).append(pa.field("last", pa.string()))


def compared(doc_id, text, own, following, next_print):
    changed = edited(text, following).encode()
    changed_print = digest(changed)
    return {"doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(changed).hexdigest(), "fingerprint": own,
            "edited_fingerprint": changed_print, "near_edited": likeness(own, changed_print), "near_next": likeness(own, next_print)}


def _in_order(batches):
    """Rows of one ordered part: every document with its follower. The last one waits for the next part, so its text goes out with it,
    and so does the text of the first, for the part before."""
    part, held, first = TaskContext.get().partitionId(), None, None
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = text or ""
            own = held[2] if held and held[1] == text else digest(text.encode())
            if held:
                rows.append(compared(*held, text, own))
            else:
                first = text
            held = doc_id, text, own
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=EDGE_ARROW)
    if held:
        yield pa.RecordBatch.from_pylist([{"doc_id": held[0], "part": part, "first": first, "last": held[1]}], schema=EDGE_ARROW)


def _at_edges(batches):
    for batch in batches:
        rows = [compared(r["doc_id"], r["last"], digest(r["last"].encode()), r["following"], digest(r["following"].encode())) for r in batch.to_pylist()]
        yield pa.RecordBatch.from_pylist(rows, schema=OUT_ARROW)


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited form, and their likeness; the next document is that of the next smaller id, after the
    smallest comes the largest. Ties are ordered by text, null ids come last.

    Texts move once, into ranges of the id; within a range each row meets its follower as it passes. Only the last row of a range
    waits, with the first row of the next one: as many rows as there are ranges.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ranged = rows.repartitionByRange(shards_of(docs), F.desc_nulls_last("doc_id")).sortWithinPartitions(F.desc_nulls_last("doc_id"), "text")
    made = cut(ranged.mapInArrow(_in_order, OUT + ", part int, first string, last string"), "digest-rows")
    edges = made.where("part IS NOT NULL").select("part", "doc_id", "last")
    parts = made.where("part IS NOT NULL").select("part")
    # One row for each range, numbered without their texts.
    whole = Window.orderBy("part")
    order = parts.select("part", F.coalesce(F.lead("part").over(whole), F.min("part").over(Window.partitionBy(F.lit(1)))).alias("then"))
    firsts = made.where("part IS NOT NULL").select(F.col("part").alias("then"), F.col("first").alias("following"))
    ends = edges.join(order, "part").join(firsts, "then").select("doc_id", "last", "following").mapInArrow(_at_edges, OUT)
    return made.where("part IS NULL").select(*OUT_ARROW.names).unionByName(ends)
