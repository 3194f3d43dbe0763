import random
from collections import defaultdict
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from kinweave import settings as S
from kinweave.operators import homonyms, network, summaries
from kinweave.plans import traces
from kinweave.sources import merges
from kinweave.streaming.refresh import merged_holding
from tests.conftest import rows


def test_clusters_against_walk(spark):
    rng = random.Random(5)
    entity = spark.createDataFrame([(i, "person", f"p{i}", f"P{i}", 0) for i in range(6)],
                                   "entity_id bigint, entity_type string, canonical_name string, display_name string, is_channel int")
    pos, hold, recs = [], [], defaultdict(list)
    for i in range(6):
        for k in range(rng.randint(3, 12) if i else 220):
            day = str(date(2020, 1, 1) + timedelta(days=rng.randint(0, 1500) if i else 97 * rng.randint(0, 15)))
            code = f"c{rng.randint(0, 1 if i < 4 else 5)}"
            table = rng.choice(["position", "holding", "holding"])
            (pos if table == "position" else hold).append((i * 1000 + k, i, code, day))
            recs[i].append((0 if table == "position" else 1, i * 1000 + k, code, day, S.POSITION_SOURCE if table == "position" else S.CHANGE_SOURCE))
    position = spark.createDataFrame([(a, b, c, "董事", S.POSITION_SOURCE, d) for a, b, c, d in pos], "id bigint, entity_id bigint, stock_code string, title string, source string, valid_from string")
    holding = spark.createDataFrame([(a, b, c, S.CHANGE_SOURCE, d) for a, b, c, d in hold], "id bigint, entity_id bigint, stock_code string, source string, valid_from string")
    want = set()
    for i, rr in recs.items():
        rr.sort()
        n = len({r[2] for r in rr})
        if len(rr) < 5:
            continue
        reps = []
        for r in rr:
            for c, q in enumerate(reps):
                days = abs((date.fromisoformat(q[3]) - date.fromisoformat(r[3])).days)
                both = q[0] == r[0] == 1
                rarity = 0.9 if n <= 2 else 0.6 if n <= 5 else 0.35 if n <= 20 else 0.15
                count = 0.7 if n <= 3 else 0.5 if n <= 10 else 0.2
                total = 0.25 * rarity + 0.25 * ((0.7 if days <= 365 else 0.5) if both else 0.5) + 0.2 * count + 0.05 * 0.5 + 0.25 * (0.65 if days <= 1095 else 0.3)
                if round(total, 3) > 0.70:
                    want.add((i, r[1], c))
                    break
            else:
                reps.append(r)
                want.add((i, r[1], len(reps) - 1))
    got = homonyms.clusters(position, holding, entity)
    assert {tuple(r) for r in got.select("entity_id", "id", "cluster").collect()} == want
    e2, p2, h2 = homonyms.split(entity, position, holding, got)
    assert e2.count() == 6 + len({(i, c) for i, _, c in want if c > 0})
    assert rows(homonyms.undo(h2, e2), "id", "entity_id") == rows(holding, "id", "entity_id")


def test_repeats_against_walk(spark):
    rng = random.Random(9)
    log = [(rng.choice("ab"), rng.randint(0, 400000)) for _ in range(300)] + [("c", 0), ("c", 3600), ("c", 3601), ("c", 3601), ("c", 7200), ("c", 14400)]
    want, before = defaultdict(int), {}
    for k, ts in sorted(log):
        want[k] += k in before and ts - before[k] < 3600
        before[k] = ts
    df = spark.createDataFrame(log, "k string, ts bigint")
    got = {r["k"]: r["h"] for r in traces.repeats(df, ["k"]).groupBy("k").agg(F.sum("repeats").alias("h")).collect()}
    assert got == dict(want) and want["c"] == 3


def test_cache_hits_against_walk(spark):
    """An entry lives from the miss that stored it, not from the time it was last asked for."""
    rng = random.Random(9)
    log = [(rng.choice("ab"), rng.randint(0, 40000)) for _ in range(300)] + [("c", 0), ("c", 1800), ("c", 3600), ("c", 3601), ("d", 5), ("d", 5)]
    want, stored = defaultdict(int), {}
    for k, ts in sorted(log):
        if k in stored and ts - stored[k] < 3600:
            want[k] += 1
        else:
            stored[k] = ts
    hits = traces.cache_hits(spark.createDataFrame(log, "k string, ts bigint"), ["k"])
    got = {r["k"]: r["h"] for r in hits.groupBy("k").agg(F.sum("hits").alias("h")).collect()}
    assert got == dict(want) and got["c"] == 2 and got["d"] == 1
    assert traces.cache_rate(hits).first().asDict() == {"n": len(log), "hits": sum(want.values())}


@pytest.mark.parametrize("name", ["TR4", "TR4_rate"])
def test_cache_queries_give_hits(spark, name):
    """The registered queries answer the whole walk, as their SQL does."""
    assert "hits" in entry_module.queries()[name](spark, "/root/testdata/sf0.001").columns
    assert "walk" in entry_module.oracle_sql()[name]


def test_shortest_path_over_a_middle_company(spark):
    links = spark.createDataFrame([("E:1", "C:a"), ("E:1", "C:b"), ("E:2", "C:b"), ("E:2", "C:c"), ("E:9", "C:z")], "src string, dst string")
    pairs = spark.createDataFrame([("C:a", "C:b"), ("C:a", "C:c"), ("C:a", "C:z")], "a string, b string")
    got = {(r["a"], r["b"]): (r["path"], r["hops"]) for r in network.shortest_paths(links, pairs, 4).collect()}
    assert got == {("C:a", "C:b"): (["C:a", "E:1", "C:b"], 2), ("C:a", "C:c"): (["C:a", "E:1", "C:b", "E:2", "C:c"], 4)}
    assert rows(network.reachable(links, spark.createDataFrame([("C:a",)], "company string"), 2), "company", "round") == [("C:a", 0), ("C:b", 1), ("C:c", 2)]
    assert rows(network.two_hop(links, hot_rows=1), "company", "other") == rows(network.two_hop(links), "company", "other")


def test_shortest_paths_against_walk(spark):
    """Random graphs of both kinds of nodes, every pair, every bound; the first in node order of all shortest paths."""
    rng = random.Random(17)
    edges = {(f"E:{rng.randrange(9)}", f"C:{rng.randrange(12)}") for _ in range(22)} | {("E:x", "E:1"), ("E:x", "C:z")}
    around = defaultdict(set)
    for a, b in edges:
        around[a].add(b)
        around[b].add(a)
    nodes = sorted(around) + ["C:none"]
    pairs = [(a, b) for a in nodes for b in nodes if a < b or rng.random() < 0.2]
    df, asked = spark.createDataFrame(sorted(edges), "src string, dst string"), spark.createDataFrame(pairs, "a string, b string")
    for bound in (1, 3, 4):
        want = {}
        for a, b in pairs:
            paths = [[a]]
            for _ in range(bound):
                paths = [[*p, n] for p in paths for n in around[p[-1]]]
                hit = [p for p in paths if p[-1] == b]
                if hit:
                    want[a, b] = min(hit)
                    break
        got = {(r["a"], r["b"]): r["path"] for r in network.shortest_paths(df, asked, bound).collect()}
        assert got == want and len({len(p) for p in want.values()}) == bound


def test_running_count(spark):
    rng = random.Random(2)
    values = [(k, v) for k in "ab" for v in rng.sample(range(-10**6, 10**6), 900)] + [("c", 5), ("d", 2**62), ("d", -2**62)]
    got = summaries.running_count(spark.createDataFrame(values, "k string, v bigint"), ["k"], "v", "at", piece=16).collect()
    want = {(k, v): i + 1 for k in "abcd" for i, v in enumerate(sorted(x for a, x in values if a == k))}
    assert {(r["k"], r["v"]): r["at"] for r in got} == want


def test_records_against_representatives(spark):
    """Every compared pair up to the match, as a walk over all records finds them."""
    rng = random.Random(8)
    entity = spark.createDataFrame([(i, "person", f"p{i}", f"P{i}", 0) for i in range(4)],
                                   "entity_id bigint, entity_type string, canonical_name string, display_name string, is_channel int")
    pos = [(i * 100 + k, i, f"c{rng.randrange(7)}", "t", S.POSITION_SOURCE, str(date(2015, 1, 1) + timedelta(days=rng.randint(0, 4000)))) for i in range(4) for k in range(6)]
    hold = [(i * 100 + k, i, f"c{rng.randrange(7)}", S.CHANGE_SOURCE, str(date(2015, 1, 1) + timedelta(days=rng.randint(0, 4000)))) for i in range(4) for k in range(25 if i else 3)]
    position = spark.createDataFrame(pos, "id bigint, entity_id bigint, stock_code string, title string, source string, valid_from string")
    holding = spark.createDataFrame(hold, "id bigint, entity_id bigint, stock_code string, source string, valid_from string")
    scores = {}
    records = {i: sorted([("position", r[0], r[4], r[5], r[2]) for r in pos if r[1] == i], key=lambda r: r[1])
               + sorted([("holding", r[0], r[3], r[4], r[2]) for r in hold if r[1] == i], key=lambda r: r[1]) for i in range(4)}
    frame = [(i, a[0], a[1], b[0], b[1], len({r[4] for r in rr}), a[2], b[2], a[3], b[3]) for i, rr in records.items() for a in rr for b in rr]
    scored = homonyms.scored_pairs(spark.createDataFrame(frame, "e int, at string, ai bigint, bt string, bi bigint, n_companies int, a_source string, b_source string, a_from string, b_from string"))
    for r in scored.collect():
        scores[r.e, r.at, r.ai, r.bt, r.bi] = r.score_m
    want = set()
    for i, rr in records.items():
        reps = []
        for r in rr:
            for c, q in enumerate(reps):
                points = scores[i, q[0], q[1], r[0], r[1]]
                want.add((i, r[0], r[1], c, q[0], q[1], points))
                if points > S.SAME_ABOVE:
                    break
            else:
                reps.append(r)
    for hot in (None, 2):
        got = homonyms.against_representatives(position, holding, entity, hot_rows=hot)
        assert {tuple(r) for r in got.select("entity_id", "table", "id", "cluster", "rep_table", "rep_id", "score_m").collect()} == want and want


def test_nearest_rank_against_sort(spark):
    rng = random.Random(1)
    vals = [(rng.choice("xy"), float(rng.randint(0, 20))) for _ in range(101)]
    got = {r["k"]: (r["n"], r["p50"], r["p95"]) for r in summaries.nearest_rank(spark.createDataFrame(vals, "k string, v double"), ["k"], "v").collect()}
    for k in "xy":
        s = sorted(v for a, v in vals if a == k)
        assert got[k] == (len(s), s[min(int(len(s) * 50 / 100), len(s) - 1)], s[min(int(len(s) * 95 / 100), len(s) - 1)])


def test_merges(spark):
    h = "id bigint, entity_id bigint, stock_code string, report_period string, shares double, ratio double, holder_rank int, source string, valid_from string, valid_to string"
    old = spark.createDataFrame([(1, 1, "a", "p", 5.0, None, 3, "s1", "v1", None)], h)
    new = spark.createDataFrame([(9, 1, "a", "p", None, 7.0, None, "s2", "v2", "t"), (10, 2, "a", "p", 1.0, None, None, "s2", "v2", None)], h)
    got = merged_holding(old, new)
    assert rows(got, "id", "shares", "ratio", "holder_rank", "source", "valid_from", "valid_to") == [(1, 5.0, 7.0, 3, "s1", "v1", "t"), (10, 1.0, None, None, "s2", "v2", None)]
    p = spark.createDataFrame([(1, 1, "a", "t", None, 1), (2, 1, "a", "t", None, 2), (3, 1, "a", "t", "d", 3), (4, 1, "a", "t", "d", 4)],
                              "id bigint, entity_id bigint, stock_code string, title string, valid_from string, seq bigint")
    assert rows(merges.dedupe_position(p), "id") == [(1,), (2,), (3,)]


def test_files(spark, tmp_path):
    from kinweave.sources.files import read_reviews, read_traces
    (tmp_path / "r.csv").write_bytes("﻿party_name,human_class\n甲,true_omission\n".encode("utf-8"))
    assert rows(read_reviews(spark, str(tmp_path / "r.csv")), "party_name", "human_class") == [("甲", "true_omission")]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "ab12.json").write_text('{\n"question": "q", "intent": "Q1", "total_elapsed_ms": 30, "events": [{"node": "classify", "elapsed_ms": 10},'
                                              ' {"node": "slot_fill", "elapsed_ms": 25}], "query_elapsed_ms": 4, "llm_calls": []}', encoding="utf-8")
    t = read_traces(spark, str(tmp_path / "t"))
    assert {(r["stage"], r["ms"]) for r in traces.stage_times(t).collect()} == {
        ("classify", 10.0), ("slot_fill", 15.0), ("entity_link", 0.0), ("execute", 4.0), ("answer_generate", 0.0), ("verify", 5.0)}
    assert rows(traces.summaries_of(t), "trace_id", "question") == [("ab12", "q")]


def test_nearest_rank_of_one_key(spark):
    rng = random.Random(9)
    values = [rng.choice([0.0, 5.0, rng.random(), 1e12 * rng.random(), -rng.random() ** 9]) for _ in range(4000)]
    df = spark.createDataFrame([("k", v) for v in values] + [("one", 3.5), ("none", None)], "key string, v double")
    want = sorted(values)
    got = {r["key"]: r for r in summaries.nearest_rank(df, ["key"], "v", (0, 50, 95, 100)).collect()}
    assert (got["k"]["n"], got["k"]["p0"], got["k"]["p50"], got["k"]["p95"], got["k"]["p100"]) == (4000, want[0], want[2000], want[3800], want[3999])
    assert got["one"]["p50"] == 3.5 and "none" not in got


def test_nearest_rank_with_outliers_and_crowds(spark):
    """Every level of cutting: values that crowd in the last bits of a fraction between far outliers, against a sort."""
    rng = random.Random(3)
    crowd = [1.0 + rng.randrange(4000) * 2.0 ** -52 for _ in range(3000)]
    values = crowd + [1e300, -1e300, float("inf"), float("-inf"), 0.0, 5e-324, float("nan")] + [rng.random() * 1e-9 for _ in range(200)]
    whole = [2 ** 60 + rng.randrange(1500) for _ in range(2000)] + [-2 ** 62, 0]
    df = spark.createDataFrame([("k", v) for v in values] + [("one", 3.5)], "key string, v double")
    want = sorted(values, key=lambda v: (v != v, v))
    asked = (0, 1, 7, 50, 95, 99, 100)
    for last in (1, 8, 65536):
        got = {r["key"]: r for r in summaries.nearest_rank(df, ["key"], "v", asked, last).collect()}
        for p in asked:
            w = want[min(len(want) * p // 100, len(want) - 1)]
            assert got["k"][f"p{p}"] == w or w != w and got["k"][f"p{p}"] != got["k"][f"p{p}"], (last, p)
        assert got["one"]["p50"] == 3.5
    got = summaries.nearest_rank(spark.createDataFrame([(1, v) for v in whole], "key int, v bigint"), ["key"], "v", (50,), 16).first()
    assert got["p50"] == sorted(whole)[len(whole) // 2]


def test_only_touched_buckets_are_written(spark, tmp_path):
    from kinweave.streaming.refresh import CandidateRefresh
    cols = "id bigint, entity_id bigint, stock_code string, report_period string, shares double, ratio double, holder_rank int, source string, valid_from string, valid_to string"
    row = lambda i, code, ratio: (i, i % 7, code, "p", None, ratio, None, "s", None, None)
    known = spark.createDataFrame([row(i, f"c{i % 40}", None) for i in range(120)], cols)
    batches = [spark.createDataFrame(x, cols) for x in ([row(1, "c1", 5.0), row(500, "new", 1.0)], [row(2, "c2", 6.0)], [])]
    sink = lambda n=16: CandidateRefresh(None, None, known, None, None, folder=str(tmp_path), buckets=n)
    state, first, want = lambda: {p: p.stat().st_mtime_ns for p in tmp_path.glob("holding/v=*/b=*/*.parquet")}, sink(), known
    assert first.before(spark, 0).count() == 120
    for k, batch in enumerate(batches):
        before, s = state(), sink()
        hit = {b for b, in batch.select(s._bucket()).distinct().collect()}
        for _ in range(2):  # a repeated batch ends in the same state
            s._write(merged_holding(s.before(spark, k, hit), batch), k)
        want = merged_holding(want, batch)
        assert before.items() <= state().items()
        assert {p.parent.name for p in set(state()) - set(before)} == {f"b={b}" for b in hit}
        cols_of = ["id", "entity_id", "stock_code", "report_period", "ratio", "source"]
        assert rows(s.before(spark, k + 1), *cols_of) == rows(want, *cols_of)
    assert len(hit) == 0 and first.before(spark, 0).where("ratio IS NOT NULL").count() == 0
    try:
        sink(8).before(spark, 3)
    except ValueError:
        return
    raise AssertionError("another number of buckets must not pass")


def test_holding_shuffles_priced_rows_once(spark, tmp_path):
    """Amounts, ranks and totals come from one shuffle of the joined rows; rows without a supplier stay, as in the SQL."""
    from kinweave.sources.tables import Tables
    spark.createDataFrame([(1, 5, "1994-02-01"), (2, 6, "1994-03-01")], "o_orderkey bigint, o_custkey bigint, o_orderdate string").write.parquet(
        str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(1, 3, 0, 30.0, 1.0), (2, 3, 1, 70.0, 2.0), (2, None, 2, 9.0, 1.0)], """l_orderkey bigint, l_suppkey bigint, l_linenumber int,
        l_extendedprice double, l_quantity double""").write.parquet(str(tmp_path / "lineitem.parquet"))
    held = Tables(spark, str(tmp_path))._holding()
    assert held._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(held.select("stock_code", "entity_id", "ratio", "holder_rank").collect(), key=str) == sorted(
        [("000003", 6, None if 6 % 4 == 0 else 70.0, 1), ("000003", 5, 30.0, 2), (None, 6, 100.0, 1)], key=str)


def test_shortest_paths_write_no_rows_per_met_node(spark, monkeypatch):
    """Ends that meet in many nodes: what is written for pairs is at most a row for each, and the first way is found."""
    left = [(f"E:{e}", c) for e in range(20, 32) for c in ("C:a", *[f"C:m{m}" for m in range(12)])]
    right = [(f"E:{e}", c) for e in range(40, 52) for c in ("C:z", *[f"C:m{m}" for m in range(12)])]
    sizes, own = {}, network.written

    def counted(df, name):
        done = own(df, name)
        sizes[name] = done.count()
        return done
    monkeypatch.setattr(network, "written", counted)
    got = network.shortest_paths(spark.createDataFrame(left + right, "src string, dst string"), spark.createDataFrame([("C:a", "C:z")], "a string, b string"), 4).collect()
    assert [(r["path"], r["hops"]) for r in got] == [(["C:a", "E:20", "C:m0", "E:40", "C:z"], 4)]
    assert max(n for name, n in sizes.items() if name[6:].rstrip("-0123456789") not in ("", "nodes", "step")) <= 1


def test_walk_of_pairs_asks_for_no_parties(spark, monkeypatch):
    from kinweave.catalog import lookup_queries
    from kinweave.sources.tables import Tables

    def none(self):
        raise AssertionError("parties were made")
    monkeypatch.setattr(Tables, "parties", property(none))
    walked = lookup_queries.q2_walk(Tables(spark, "/root/testdata/sf0.001"))
    assert walked.columns == ["a", "b", "related", "path"] and walked.count() > 0


def test_disclosed_counts_are_those_of_all_parties(spark, monkeypatch):
    from kinweave.operators import folding
    from kinweave.plans import evaluation as ev
    from kinweave.sources.tables import Tables
    t = Tables(spark, "/root/testdata/sf0.001")
    gold = ev.with_scope(t.gold)
    sides = ev.align(t.parties, gold).where("side <> 'system_only'").groupBy("stock_code").agg(
        F.count_if(F.col("side") == "matched").alias("n_matched"), F.count_if(F.col("side") == "gold_only").alias("n_gold_only"))
    # Every company also discloses the one after it, which may be under the same controller, and itself.
    more = gold.unionByName(t.company.select(F.lit(-1).cast("bigint").alias("id"), "stock_code", F.lit(2024).alias("report_year"), F.explode(F.array(
        "short_name", F.concat(F.lit("Supplier#"), F.lpad((F.col("stock_code").cast("int") + 1).cast("string"), 9, "0")))).alias("party_name"), F.lit(None).cast("bigint").alias("party_entity_id"),
        F.lit("").alias("relation_desc"), F.lit(1).alias("source_page"), F.lit("other").alias("scope_class")), allowMissingColumns=True)
    wide = ev.align(t.parties, more).where("side <> 'system_only'").groupBy("stock_code").agg(
        F.count_if(F.col("side") == "matched").alias("n_matched"), F.count_if(F.col("side") == "gold_only").alias("n_gold_only"))
    others, cols = folding.fold_runs(t.runs_outside_control), ("stock_code", "n_matched", "n_gold_only")
    assert rows(ev.disclosed_counts(others, t.members, gold), *cols) == rows(sides, *cols)
    assert rows(ev.disclosed_counts(others, t.members, more), *cols) == rows(wide, *cols)

    def none(self):
        raise AssertionError("all parties were made")
    monkeypatch.setattr(Tables, "parties", property(none))
    monkeypatch.setattr(Tables, "candidates", property(none))
    assert entry_module.queries()["Q9"](spark, t.folder).count() == t.company.count()


def test_review_order_asks_for_no_paths(spark, monkeypatch):
    from kinweave.sources.tables import Tables

    def none(self):
        raise AssertionError("paths were made")
    monkeypatch.setattr(Tables, "runs", property(none))
    monkeypatch.setattr(Tables, "parties", property(none))
    assert entry_module.queries()["W9"](spark, "/root/testdata/sf0.001").count() > 0
