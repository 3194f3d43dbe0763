"""WARC archives with an index: write offset, length, address and digest of every record, then read chosen records by sorted,
coalesced byte ranges.

Each task writes archives of bounded size into the shared folder, one gzip member per record, under a name of its own; the index
that Spark commits names only archives of the attempts that counted, so a lost executor or a second attempt leaves nothing that is
read. Of records with equal payloads the one with the smallest id is the response and the others are revisits without a payload;
payloads below `least` bytes are all responses.

A null payload is an empty one, a null address is written as an empty target and read back as null, and equal ids are ordered by
address. Ids may repeat: a revisit names the id of its response. An empty table gives an empty index.
"""
import base64
import gzip
import hashlib
import uuid
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.tables import cut, shards_of
from kinweave.session import shared_dir

#: A new archive begins after so many bytes.
ARCHIVE_BYTES = 64 << 20
#: Ranges closer than this are read as one; a read takes at most so many bytes, or one record.
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20

INDEX_TYPE = "archive string, offset long, length long, page_id long, url string, payload_digest string, payload_bytes long, record_type string, refers_to long"
INDEX_ARROW = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()),
                         ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64())])
READ_TYPE = ("page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary, "
             "intact boolean, offset long, archive string")
READ_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()),
                        ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("intact", pa.bool_()), ("offset", pa.int64()), ("archive", pa.string())])


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def place(uri: str):
    """File system and path of a folder in the shared store."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def record(page_id, url, kind, refers_to, sha1, payload: bytes) -> bytes:
    """One record as a gzip member; the block of a revisit is empty, its digest and length are those of the full payload."""
    block = payload if kind == "response" else b""
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z",
            f"WARC-Payload-Digest: sha1:{sha1}", f"X-Payload-Length: {len(payload)}", f"Content-Length: {len(block)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=~-._')}")
    if kind == "revisit":
        head += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    data = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return gzip.compress(data, 5, mtime=0)


def parse(data: bytes) -> dict:
    """Fields of the record in one gzip member."""
    head, _, rest = gzip.decompress(data).partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    number = lambda k: int(v) if (v := fields.get(k, "<urn:page:>")[10:-1]) else None
    block = rest[: int(fields["Content-Length"])]
    kind, sha1, size = fields["WARC-Type"], fields["WARC-Payload-Digest"][5:], int(fields["X-Payload-Length"])
    whole = rest == block + b"\r\n\r\n" and (kind == "revisit" and not block or len(block) == size and digest(block) == sha1)
    return {"page_id": number("WARC-Record-ID"), "url": unquote(fields["WARC-Target-URI"]) if "WARC-Target-URI" in fields else None,
            "record_type": kind, "refers_to": number("WARC-Refers-To") if kind == "revisit" else None, "payload_digest": sha1,
            "payload_bytes": size, "payload": block if kind == "response" else None, "intact": whole}


def _writer(folder: str, most: int):
    def write(batches):
        store, path = place(folder)
        store.create_dir(path, recursive=True)
        out, name, at = None, None, 0
        for batch in batches:
            rows = []
            cols = [batch.column(c) for c in ("page_id", "url", "payload", "record_type", "refers_to")]
            for i in range(batch.num_rows):
                page_id, url, payload, kind, refers_to = (c[i].as_py() for c in cols)
                if out is None or at >= most:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                sha1 = digest(payload)
                data = record(page_id, url, kind, refers_to, sha1, payload)
                out.write(data)
                rows.append((name, at, len(data), page_id, url, sha1, len(payload), kind, refers_to))
                at += len(data)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * len(INDEX_ARROW), INDEX_ARROW.types)], schema=INDEX_ARROW)
        if out is not None:
            out.close()
    return write


def write_archives(pages: DataFrame, least: int = 0, most: int = ARCHIVE_BYTES, key: str = "page_id", url: str = "url", body: str = "html"):
    """Write every row as a record; returns the folder and the index (INDEX_TYPE).

    Equal payloads are those of one SHA-256. The smallest id of each is counted before the shuffle, written out, and joined back to
    the rows; both sides of that join are plain reads, so that a payload with a third of all rows is split.
    """
    folder = f"{shared_dir(pages.sparkSession)}/kinweave/warc-{uuid.uuid4().hex[:12]}"
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                        F.coalesce(F.col(body), F.lit("")).cast("binary").alias("payload"))
    marked = rows.withColumn("sha", F.sha2("payload", 256))
    # Ids first in order, then addresses; null ids come last. Rows equal in both are all responses.
    place_of = F.struct(F.col("page_id").isNull().alias("last"), "page_id", F.coalesce("url", F.lit("")).alias("url"))
    firsts = cut(marked.where(F.octet_length("payload") >= least).groupBy("sha").agg(F.min(place_of).alias("first"), F.count("*").alias("n"))
                 .where("n > 1").withColumnRenamed("sha", "of"), "warc-firsts")
    joined = marked.join(firsts, marked["sha"] == firsts["of"], "left")
    again = F.col("n").isNotNull() & ~place_of.eqNullSafe(F.col("first"))
    ready = joined.select("page_id", "url", "payload", F.when(again, "revisit").otherwise("response").alias("record_type"),
                          F.when(again, F.col("first.page_id")).alias("refers_to"))
    return folder, cut(ready.mapInArrow(_writer(folder, most), INDEX_TYPE), "warc-index")


def ranges(index: list, gap: int = GAP_BYTES, most: int = READ_BYTES):
    """(start, end, records) of the reads for (offset, length) pairs in order: near records share a read."""
    start = end = None
    held = []
    for offset, length in index:
        if held and (offset - end > gap or offset + length - start > most):
            yield start, end, held
            held = []
        if not held:
            start, end = offset, offset
        held.append((offset, length))
        end = max(end, offset + length)
    if held:
        yield start, end, held


def _reader(folder: str, gap: int, most: int):
    def read(batches):
        store, path = place(folder)
        for batch in batches:
            names, offsets, lengths = (batch.column(c).to_pylist() for c in ("archive", "offset", "length"))
            i = 0
            while i < len(names):
                j = i
                while j < len(names) and names[j] == names[i]:
                    j += 1
                with store.open_input_file(f"{path}/{names[i]}") as f:
                    for start, end, held in ranges(list(zip(offsets[i:j], lengths[i:j])), gap, most):
                        f.seek(start)
                        data = f.read(end - start)
                        rows = [parse(data[o - start:o - start + n]) | {"offset": o, "archive": names[i]} for o, n in held]
                        yield pa.RecordBatch.from_pylist(rows, schema=READ_ARROW)
                i = j
    return read


def read_records(folder: str, chosen: DataFrame, gap: int = GAP_BYTES, most: int = READ_BYTES) -> DataFrame:
    """Records of the chosen index rows (archive, offset, length). Reads go in order of archive and offset, split over tasks by
    ranges of both, so one large archive is read by many tasks."""
    spread = chosen.select("archive", "offset", "length").repartitionByRange(shards_of(chosen), "archive", "offset")
    return spread.sortWithinPartitions("archive", "offset").mapInArrow(_reader(folder, gap, most), READ_TYPE)


def archive_pages(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write the archives, read every record back and report what the archives hold; raises in the task that meets a damaged record."""
    folder, index = write_archives(pages, least)
    checked = F.when(F.col("intact"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("damaged record")))
    return read_records(folder, index).select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")
