"""Sharding, mixing, tokens, archives, fingerprints against plain versions."""
import base64
import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
import regex
from pyspark.sql import functions as F

from kinweave.llm import fingerprints, mixing, queries, sharding, token_counts, warc
from tests.llm.common import LONG, ODD, documents, empty

FOLDER = "/root/testdata/sf0.001"


def jump(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 2, 24, 1000])
def test_jump(spark, shards):
    keys = [0, 1, -1, 2**63 - 1, -2**63, 123456789, *range(50)]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select(sharding.jump_shard(F.col("k"), shards)).collect()
    assert [r[0] for r in got] == [jump(k, shards) for k in keys]


def test_shards_and_slots(spark):
    rows = sharding.shard_documents(documents(spark)).collect()
    assert len(rows) == len(ODD)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in ODD)
    slots = defaultdict(list)
    for r in rows:
        assert r.shard == jump(r.doc_id or 0, 24) and r.grown_shard in (r.shard, 24)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(empty(spark)).count() == 0


def test_water_fill(spark):
    sizes = {"a": 100, "b": 1000, "c": 10, "d": 0, None: 50}
    got = {r.source: r.target for r in mixing.water_fill(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    weights = dict(zip(["a", "b", "c", "d", None], (5, 2, 1, 5, 2)))
    want, free = {}, dict(weights)
    left = sum(sizes.values())
    while True:
        level = left / sum(free.values())
        capped = [s for s in free if free[s] * level > 3 * sizes[s]]
        if not capped:
            break
        for s in capped:
            want[s] = 3 * sizes[s]
            left -= want[s]
            del free[s]
    want |= {s: w * level for s, w in free.items()}
    assert got == pytest.approx(want)


def test_mix(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), "en", f"s{i % 4}" if i % 5 else None, 0) for i in range(400)], documents(spark, clash=False).schema)
    rows = mixing.mix_words(docs).collect()
    again = mixing.mix_words(docs.repartition(7)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    taken = defaultdict(int)
    for r in rows:
        assert r.taken % r["size"] == 0 and r.taken <= 3 * r["size"]
        taken[r.doc_id % 4 if r.doc_id % 5 else None, r.target] += r.taken
    assert all(abs(t - target) <= 4 for (_, target), t in taken.items())
    copies = Counter(r.doc_id for r in mixing.mixed(docs).collect())
    assert copies == Counter({r.doc_id: r.taken // r["size"] for r in rows if r.taken})


def test_mix_odd(spark):
    docs = documents(spark)
    assert mixing.mix_words(docs).count() == len(ODD)
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mix_words(empty(spark)).count() == 0 and mixing.mixed(empty(spark)).count() == 0


def test_mix_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    want = con.execute(queries.ORACLES["op7_water_filling"]).fetchall()
    got = queries.QUERIES["op7_water_filling"](spark, FOLDER)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_token_counts(spark):
    scores = token_counts.zipf_scores()
    longest, words = max(map(len, scores)), regex.compile(token_counts.PATTERN)
    for nodes in (token_counts.NODES, 10):
        for r in token_counts.count_tokens(documents(spark), nodes=nodes).collect():
            text = next(t for i, t, *_ in ODD if i == r.doc_id) or ""
            found = Counter(words.findall(text))
            assert r.n_bytes == len(text.encode()) and r.n_pretokens == sum(found.values())
            assert r.n_tokens == sum(n * token_counts.best_split(w.encode(), scores, longest) for w, n in found.items())
    assert token_counts.count_tokens(empty(spark)).count() == 0


def test_best_split_is_best():
    scores = {b"a": -1.0, b"b": -1.0, b"ab": -1.5, b"ba": -1.0, b"aba": -2.0}

    def every(word):
        return [[]] if not word else [[p, *rest] for p in scores if word.startswith(p) for rest in every(word[len(p):])]
    for word in (b"", b"a", b"ab", b"aba", b"abba", b"babab"):
        best = min(every(word), key=lambda ps: (-sum(scores[p] for p in ps), len(ps)))
        assert token_counts.Trie(scores).count(word.decode()) == token_counts.best_split(word, scores, 3) == len(best)


PAGES = [(1, "http://a/ä?b=1 2", "<p>x</p>"), (2, None, None), (3, "http://a/c", ""), (4, "http://b/", "<p>x</p>"), (5, "http://b/", "<p>x</p>"), (7, "u\r\nWARC-Type: x", "\r\n\r\n"),
         (None, "http://n/", "<p>x</p>"), (8, "http://l/", LONG)]


@pytest.mark.parametrize("least", [0, 1])
def test_archives(spark, least):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 as payload", "2 as sha", "3 as n")
    folder, index = warc.write_archives(pages, least, most=200)
    held = {r.page_id: r for r in index.collect()}
    back = {r.page_id: r for r in warc.read_records(folder, index).collect()}
    first = {}
    for i, _, html in sorted(PAGES, key=lambda p: (p[0] is None, p[0])):
        first.setdefault(html or "", i)
    for i, url, html in PAGES:
        data, r = (html or "").encode(), back[i]
        kind = "response" if first[html or ""] == i or len(data) < least else "revisit"
        assert (r.url, r.record_type, r.payload_bytes, r.intact) == (url, kind, len(data), True)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode() == held[i].payload_digest
        assert r.refers_to == (first[html or ""] if kind == "revisit" else None) and (r.payload is None or bytes(r.payload) == data)
    some = warc.read_records(folder, index.where("page_id % 2 = 0")).collect()
    assert {r.page_id for r in some} == {2, 4, 8}
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_ranges():
    assert [(s, e) for s, e, _ in warc.ranges([(0, 10), (10, 10), (500, 10), (505, 10)], gap=20, most=1000)] == [(0, 20), (500, 515)]
    assert [(s, e) for s, e, _ in warc.ranges([(0, 10), (10, 10), (20, 10)], gap=20, most=20)] == [(0, 20), (20, 30)]


def test_fingerprints(spark):
    rows = fingerprints.fingerprint_documents(documents(spark)).collect()
    order = sorted(((i, t or "") for i, t, *_ in ODD), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    want = Counter()
    for k, (i, text) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        changed = fingerprints.edited(text, following).encode()
        a, b = fingerprints.digest(text.encode()), fingerprints.digest(changed)
        want[i, len(text), hashlib.sha256(changed).hexdigest(), a, b, fingerprints.likeness(a, b), fingerprints.likeness(a, fingerprints.digest(following.encode()))] += 1
    assert Counter(tuple(r[:7]) for r in rows) == want
    assert fingerprints.fingerprint_documents(empty(spark)).count() == 0


def test_digest_counts_and_distances():
    data = bytes(range(256)) * 9
    slow = Counter((data[i] | data[i + 1] << 8 | data[i + 2] << 16) * 2654435769 % 2**32 >> 24 for i in range(len(data) - 2))
    assert Counter({i: int(n) for i, n in enumerate(fingerprints.counts(data)) if n}) == slow
    assert fingerprints.likeness(fingerprints.digest(data), fingerprints.digest(data)) == 1.0
    assert 0 <= fingerprints.likeness(fingerprints.digest(data), fingerprints.digest(b"")) < 1
    near = fingerprints.likeness(fingerprints.digest(LONG.encode()), fingerprints.digest(LONG[:-50].encode()))
    assert near > fingerprints.likeness(fingerprints.digest(LONG.encode()), fingerprints.digest(data))
