"""SimHash join, centroid clustering and ranked search against plain versions."""
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from kinweave.llm import centroids, queries, ranking, simhash
from tests.llm.common import LONG, ODD, documents, empty

FOLDER = "/root/testdata/sf0.001"


def plain_print(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    runs = [words[i:i + 3] for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(" ".join(r).encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, bits=2):
    """Smallest id that each fingerprint reaches, by comparing all with all."""
    least = {}
    for i, p in rows:
        if i is not None:
            least[p] = min(least.get(p, i), i)
    top = {p: p for p in least}

    def root(p):
        while top[p] != p:
            p = top[p]
        return p
    for p in least:
        for q in least:
            if (p ^ q).bit_count() <= bits:
                top[root(p)] = root(q)
    best = {}
    for p, i in least.items():
        best[root(p)] = min(best.get(root(p), i), i)
    return {p: best[root(p)] for p in least}


def near_texts(n=150, seed=7):
    """Chains of texts, each of which differs from the one before in a word."""
    rng, out = random.Random(seed), []
    for c in range(n // 10):
        words = [rng.choice("abcdefghijklmnop") + str(rng.randrange(50)) for _ in range(rng.choice([2, 40, 200, 900]))]
        for _ in range(10):
            out.append(" ".join(words))
            words = list(words)
            words[rng.randrange(len(words))] = f"x{rng.randrange(1000)}"
    return out


@pytest.mark.parametrize("leaf, queries_", [(simhash.LEAF, simhash.QUERIES), (2, 3)])
def test_simhash(spark, leaf, queries_, monkeypatch):
    monkeypatch.setattr(simhash, "QUERIES", queries_)
    rows = [*ODD, *[(100 + i, t, "en", "a", 0) for i, t in enumerate(near_texts())], (None, near_texts()[0], "en", "a", 0), (90, "Same\ttext HERE  for two", "en", "a", 0)]
    got = simhash.near_duplicates(documents(spark, rows), leaf=leaf).collect()
    prints = [(i, plain_print(t)) for i, t, *_ in rows]
    want = plain_components(prints)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter((i, f"{p:016x}", want.get(p)) for i, p in prints)
    assert len({c for c in want.values()}) < len(want)
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_simhash_finds_every_link_of_crowds(spark):
    """Crowds around a centre, chains and far ones, split down to single bits."""
    rng = random.Random(11)
    prints = {0, 2**64 - 1}
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            p = centre
            for b in rng.sample(range(64), rng.randint(0, 5)):
                p ^= 1 << b
            prints.add(p)
    signed = [(int(np.array(p, np.uint64).view(np.int64)),) for p in prints]
    for leaf in (1, 20, 10_000):
        found = simhash.links(spark.createDataFrame(signed, "print long"), leaf=leaf).collect()
        top = {p: p for p in prints}

        def root(p, top=top):
            while top[p] != p:
                p = top[p]
            return p
        for a, b in ((r.a % 2**64, r.b % 2**64) for r in found):
            top[root(a)] = root(b)
        want = plain_components([(p % 2**63, p) for p in prints])
        groups = defaultdict(set)
        for p in prints:
            groups[root(p)].add(p)
        expected = defaultdict(set)
        for p, c in want.items():
            expected[c].add(p)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_rings_and_steps():
    rng = np.random.default_rng(3)
    prints, v = rng.integers(0, 2**63, 50, np.uint64), np.uint64(12345)
    for stretches in (1, 2, 8, 64):
        rings = simhash.ring(prints, v, stretches)
        width = 64 // stretches
        assert rings.tolist() == [[(((int(p) ^ 12345) >> (i * width)) & (2**width - 1)).bit_count() for i in range(stretches)] for p in prints]
    assert len(simhash.steps((0, 0), 2)) == 5 and len(simhash.steps((1, -1), 2)) == 4 and len(simhash.steps((2, 0), 2)) == 3
    assert simhash.fingerprint(LONG.encode()) == plain_print(LONG)


def plain_clusters(rows, size=64, k=40, rounds=5):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == size and all(x is not None and math.isfinite(x) and abs(x * 256) < 2**27 for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is None, r[0] or 0, r[1]))[:k]
    points = [v for _, v in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, p)), c) for c, p in enumerate(points)) for _, v in kept]
    for _ in range(rounds):
        at = assign()
        for c in range(len(points)):
            mine = [v for (_, v), (_, x) in zip(kept, at) if x == c]
            if mine:
                points[c] = [sum(x) // len(mine) for x in zip(*mine)]
    at = assign()
    per = Counter()
    for d, c in at:
        per[c] += d
    return Counter((i, c, d, per[c], sum(per.values()), hashlib.sha256(",".join(map(str, points[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, at))


def vector_rows(size):
    rng = random.Random(2)
    point = lambda: [rng.choice([-1.0, -0.25, 0.0, 0.3, 7.5]) for _ in range(size)]
    rows = [(i, point()) for i in range(90)]
    rows += [(200 + i, rows[3][1]) for i in range(20)] + [rows[5]] * 3 + [(None, point()), (None, rows[7][1])]
    rows += [(300, None), (301, []), (302, point()[1:]), (303, [*point(), 0.0]), (304, [None, *point()[1:]]), (305, [float("nan"), *point()[1:]]), (306, [float("-inf"), *point()[1:]]),
             (307, [1e30, *point()[1:]]), (308, [500_000.0, *point()[1:]])]
    return rows


@pytest.mark.parametrize("size, k, kind", [(64, 40, "double"), (2, 7, "float"), (3, 1, "double"), (2, 500, "float")])
def test_clusters(spark, size, k, kind):
    rows = vector_rows(size)
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("*", "1 as cluster", "2 as vector", "3 as distance")
    got = Counter(map(tuple, centroids.cluster(df, size=size, k=k).collect()))
    if kind == "float":
        rows = [(i, v and [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert got == plain_clusters(rows, size, k)
    nothing = centroids.cluster(df.limit(0), size=size, k=k)
    assert nothing.count() == 0 and nothing.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.mark.parametrize("spread", [1, 3, 1000])
def test_nearest_with_ties(spread):
    rng = np.random.default_rng(spread)
    points = rng.integers(-spread, spread + 1, (37, 4))
    vectors = rng.integers(-2 * spread, 2 * spread + 1, (500, 4))
    for leaf in (1, 4, 100):
        number, distance = centroids.VantageTree(points, leaf).nearest(vectors)
        away = ((vectors[:, None, :] - points[None]) ** 2).sum(2)
        assert (distance == away.min(1)).all() and (number == away.argmin(1)).all()


@pytest.mark.parametrize("name", ["op12_vantage_centroids", "op13_stratified_search"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    rel = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in rel.description]
    got = queries.QUERIES[name](spark, FOLDER).select(*columns).collect()
    assert Counter(map(tuple, got)) == Counter(rel.fetchall())


def plain_search(rows, items, best=20):
    word = re.compile(ranking.PATTERN)
    terms = lambda t: word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    docs = [(i, Counter(terms(t))) for i, t, *_ in rows]
    docs = [d for d in docs if d[1]]
    n_docs, total, df = len(docs), sum(sum(c.values()) for _, c in docs), Counter(t for _, c in docs for t in c)
    asked = defaultdict(Counter)
    for i, t in {(i, t) for i, t in items}:
        asked[i].update(terms(t))
    out = []
    for item, want in asked.items():
        scored = []
        for i, c in docs:
            m = 75 + 25 * sum(c.values()) * n_docs // total
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, q in want.items() if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:best])]
    return sorted(out, key=str)


@pytest.mark.parametrize("blocks, window", [((1024, 1 << 17), (4096, 1 << 18, 1 << 20)), ((3, 40), (5, 12, 8))])
def test_search(spark, blocks, window, monkeypatch):
    for name, value in zip(("WINDOW_DOCS", "WINDOW_POSTINGS", "ADDED"), window):
        monkeypatch.setattr(ranking, name, value)
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.choice([1, 1, 2]) for _ in range(n))
    rows = [*ODD, *[(100 + i, text(rng.choice([3, 8, 8, 30])), "en", "a", 0) for i in range(200)], (None, "a b c d", "en", "a", 0)]
    rows += [(400 + i, "A b! c-d", "en", "a", 0) for i in range(30)] + [rows[40]] * 3
    items = [(i, text(6)) for i in range(12)] + [(20, None), (21, ""), (22, "zzzz qqqq"), (23, "a a b a"), (23, "c d"), (23, "c d"), (None, "one é"), (24, "Text, text HERE; 9"), (25, LONG)]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as term", "2 as item", "3 as place")
    got = ranking.search(documents(spark, rows), bench, block_items=blocks[0], block_terms=blocks[1]).collect()
    assert sorted(map(tuple, got), key=str) == plain_search(rows, items)
    assert ranking.search(empty(spark), bench).count() == 0 and ranking.search(documents(spark), bench.limit(0)).count() == 0
    named = ranking.search(documents(spark, rows), bench.selectExpr("concat('i', item_id) item_id", "text"), best=3)
    assert Counter(r.item_id for r in named.collect())["i23"] == 3


@pytest.mark.parametrize("added", [1, 8, 1 << 20])
def test_scores_in_pieces(monkeypatch, added):
    import pyarrow as pa
    monkeypatch.setattr(ranking, "ADDED", added)
    rng = random.Random(added)
    held = [(i, t, rng.randint(0, 9)) for i in range(6) for t in "abcde" if rng.random() < 0.6]
    items = ranking.Items(pa.table({"item": [h[0] for h in held], "term": [h[1] for h in held], "gain": [h[2] for h in held]}))
    names = items.vocabulary.to_pylist()
    row, term, impact = (np.array([rng.randrange(n) for _ in range(40)]) for n in (7, len(names), 1000))
    want = np.zeros((7, items.n), np.int64)
    for r, t, x in zip(row, term, impact):
        for i, name, gain in held:
            want[r, i] += x * gain * (name == names[t])
    assert (items.scored(row, term, impact, 7) == want).all()
