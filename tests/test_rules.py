import itertools
import random

import pytest
from pyspark.sql import functions as F

from kinweave.functions.paths import with_attr_maps
from kinweave.operators import folding, rules
from kinweave.sources.tables import Tables
from tests.conftest import rows


@pytest.fixture(scope="module")
def world(spark):
    company = spark.createDataFrame([(f"00000{i}", f"C{i}", None) for i in range(1, 7)], "stock_code string, short_name string, full_name string")
    ent = [(1, "person", "张三", 0, "medium"), (2, "person", "李四", 0, "medium"), (3, "person", "王五", 0, "high"), (4, "org", "股东X公司", 0, "medium"),
           (5, "org", "香港中央结算有限公司", 1, "medium"), (6, "person", "赵六", 0, "medium"), (7, "org", "国务院国资委", 1, "medium")]
    entity = spark.createDataFrame([(i, t, n, n, c, k) for i, t, n, c, k in ent],
                                   "entity_id bigint, entity_type string, canonical_name string, display_name string, is_channel int, confidence string")
    H = "id bigint, entity_id bigint, stock_code string, report_period string, shares double, ratio double, holder_rank int, source string, valid_from string, valid_to string"
    batch, change = "stock_gdfx_free_holding_detail_em", "stock_ggcg_em"
    holding = spark.createDataFrame([
        (1, 4, "000001", "2025-12-31", 100.0, 30.0, 1, batch, "2025-12-31", None), (2, 4, "000005", "2025-12-31", 100.0, 30.0, 1, batch, "2025-12-31", None),
        (3, 5, "000001", "2025-12-31", 50.0, 15.0, 2, batch, "2025-12-31", None), (4, 3, "000004", "2025-12-31", 10.0, 8.0, 3, change, "2025-12-31", None)], H)
    P = "id bigint, entity_id bigint, stock_code string, title string, title_class string, source string, valid_from string, valid_to string"
    pos = [(1, 2, "000001", "董事", "director"), (2, 2, "000003", "董事", "director"), (3, 6, "000001", "独立董事", "independent_director"),
           (4, 6, "000006", "独立董事", "independent_director"), (5, 3, "000001", "董事长", "director")]
    position = spark.createDataFrame([(*p, "inner_trade", "2024-01-01", None) for p in pos], P)
    A = "id bigint, stock_code string, entity_id bigint, control_ratio double, source string, valid_from string, valid_to string"
    controller = spark.createDataFrame([(1, "000001", 1, 45.0, "cninfo", "2020-01-01", None), (2, "000002", 1, 40.0, "cninfo", "2020-01-01", None),
                                        (3, "000001", 7, 99.0, "cninfo", "2020-01-01", None), (4, "000006", 7, 99.0, "cninfo", "2020-01-01", None)], A)
    return dict(company=company, entity=entity, holding=holding, position=position, controller=controller)


def found(world, **kw):
    df = folding.readable(folding.fold(rules.all_candidates(**{**world, **kw})))
    return {(r["subject_code"], r["party_id"]): r for r in df.collect()}


def test_scenario(world):
    c = found(world)
    assert c["000001", "E:4"]["confidence"] == "high" and c["000001", "E:4"]["score_c"] == 85
    assert ("000001", "E:5") not in c
    assert c["000004", "E:3"]["rule_id"] == "R1"
    assert c["000001", "C:000002"]["rule_id"] == "R2" and ("000001", "C:000006") not in c
    assert c["000001", "C:000005"]["confidence"] == "low" and c["000001", "C:000005"]["rule_id"] == "R3"
    assert c["000001", "C:000003"]["confidence"] == "medium" and c["000001", "C:000003"]["rule_id"] == "R4"
    assert c["000001", "C:000004"]["confidence"] == "high" and c["000001", "C:000004"]["rule_id"] == "R5"
    assert c["000001", "C:000002"]["path"] == "000001 -CONTROLLED_BY [45.0%]-> 张三 | 张三 -CONTROLS-> 000002"
    assert all(r["confidence"] in ("high", "medium", "low") and r["path"] for r in c.values())


def test_different_period_is_no_common_holder(world):
    h = world["holding"].withColumn("report_period", F.when(F.col("stock_code") == "000005", "2024-12-31").otherwise(F.col("report_period")))
    assert ("000001", "C:000005") not in found(world, holding=h)


def test_subject_filter_and_as_of(world, spark):
    only = spark.createDataFrame([("000002",)], "stock_code string")
    assert {k[0] for k in found(world, subjects=only)} == {"000002"}
    assert ("000001", "C:000002") not in found(world, as_of="2019-01-01")
    assert ("000001", "E:4") in found(world, as_of="2019-01-01")
    assert ("000001", "E:4") not in found(world, as_of="2019-01-01", strict_as_of=True)


def test_hot_keys_give_the_same_pairs(world):
    w = world
    for hot in (1, 2):
        assert rows(rules.r2_same_control(w["controller"], w["entity"], w["company"], hot_rows=hot), "subject_code", "party_id", "k1", "k2") == rows(
            rules.r2_same_control(w["controller"], w["entity"], w["company"]), "subject_code", "party_id", "k1", "k2")
        assert rows(rules.r4_chain_director(w["position"], w["entity"], w["company"], hot_rows=hot), "subject_code", "party_id", "k1", "k2") == rows(
            rules.r4_chain_director(w["position"], w["entity"], w["company"]), "subject_code", "party_id", "k1", "k2")


def step_by_step(cands):
    """The fold one candidate at a time."""
    state = None
    for rule, conf, score, name in cands:
        if state is None:
            state = [conf, score, name, {rule}]
        elif conf > state[0]:
            state = [conf, min(100, max(state[1], score) + 10), name, state[3] | {rule}]
        else:
            state = [state[0], min(100, state[1] + 10), state[2], state[3] | {rule}]
    return state


def test_fold_equals_one_by_one(spark):
    rng = random.Random(7)
    score = {2: 90, 3: 30, 4: 70, 5: 80, 6: 75, 7: 70}
    data, want = [], {}
    for pair in range(60):
        cands = []
        for i in range(rng.randint(1, 9)):
            rule = rng.choice(list(score))
            conf = rng.choice([1, 2, 3]) if rule == 4 else {2: 3, 3: 1}.get(rule, 3)
            cands.append((rule, conf, i))
        cands.sort(key=lambda c: (c[0], -c[1], c[2]))
        for rule, conf, i in cands:
            data.append((f"s{pair}", "p", f"n{rule}", f"R{rule}", rule, "x", conf, score[rule], i, 0, "", [], [], ""))
        want[f"s{pair}"] = step_by_step([(r, c, score[r], f"n{r}") for r, c, _ in cands])
    from kinweave.functions.paths import EVIDENCE_TYPE, HOP_TYPE
    df = spark.createDataFrame(data, f"subject_code string, party_id string, party_name string, rule_id string, rule_no int, confidence string, conf_rank int, "
                                     f"score_c int, k1 bigint, k2 bigint, k3 string, path array<{HOP_TYPE}>, evidence array<{EVIDENCE_TYPE}>, as_of_date string")
    for r in folding.fold(df).collect():
        conf, sc, name, ids = want[r["subject_code"]]
        assert (r["score_c"], r["party_name"], r["rule_id"]) == (sc, name, "+".join(f"R{i}" for i in sorted(ids)))
        assert {"high": 3, "medium": 2, "low": 1}[r["confidence"]] == conf


def test_chains_against_enumeration(spark):
    rng = random.Random(3)
    n = 6
    company = spark.createDataFrame([(f"{i:06d}", f"N{i}", None) for i in range(n)], "stock_code string, short_name string, full_name string")
    ents = [(i, f"N{i}" if i < n else f"P{i}", int(i % 5 == 4)) for i in range(10)]
    entity = spark.createDataFrame([(i, d, c) for i, d, c in ents], "entity_id bigint, display_name string, is_channel int")
    edges = [(k, rng.randrange(10), f"{rng.randrange(n):06d}", float(rng.randint(10, 90))) for k in range(40)]
    holding = spark.createDataFrame(edges, "id bigint, entity_id bigint, stock_code string, ratio double")
    chan = {i for i, _, c in ents if c}
    want = set()
    for a in edges:
        for b in edges:
            if a[1] < n and b[2] == f"{a[1]:06d}" and b[1] not in chan:
                p2 = a[3] * (b[3] / 100)
                if p2 >= 20:
                    want.add((a[2], b[1], 2, f"{a[0]}>{b[0]}"))
                for c in edges:
                    if b[1] < n and c[2] == f"{b[1]:06d}" and c[1] not in chan and p2 * (c[3] / 100) >= 20:
                        want.add((a[2], c[1], 3, f"{a[0]}>{b[0]}>{c[0]}"))
    got = rules.ownership_chains(holding, entity, company, 3, 20.0)
    got = {(r[0], r[1], r[2], ">".join(map(str, r[3]))) for r in got.select("target_code", "entity_id", "hops", "edge_ids").collect()}
    assert got == want and any(x[2] == 3 for x in want)


def test_event_rule_directions(spark):
    g = spark.createDataFrame([(1, "a", "b", 5.0, "s", "d"), (2, "c", "c", 1.0, "s", "d")], "id bigint, subject_code string, counterparty_code string, amount double, source string, event_date string")
    assert rows(rules.r7_event(g), "subject_code", "party_id") == [("a", "C:b"), ("b", "C:a")]
    assert rows(rules.r7_event(g, one_direction=True), "subject_code", "party_id") == [("a", "C:b")]


@pytest.fixture(scope="module")
def crowd(spark):
    """Random facts with repeated keys, ties of ratios and a person without a name."""
    rng = random.Random(21)
    company = spark.createDataFrame([(f"{i:06d}", f"C{i}", None) for i in range(9)], "stock_code string, short_name string, full_name string")
    entity = spark.createDataFrame([(i, "person", f"p{i}", None if i == 3 else f"P{i}", int(i % 6 == 5), rng.choice(["high", "medium", "low", None])) for i in range(12)],
                                   "entity_id bigint, entity_type string, canonical_name string, display_name string, is_channel int, confidence string")
    code = lambda: f"{rng.randrange(10):06d}"
    day = lambda: f"2020-0{rng.randint(1, 9)}-01"
    holding = spark.createDataFrame([(i, rng.randrange(13), code(), f"2020-{rng.choice(['06', '12'])}", 1.0, rng.choice([None, 3.0, 5.0, 30.0]), rng.randint(1, 12), "s", day(), None)
                                     for i in range(120)], "id bigint, entity_id bigint, stock_code string, report_period string, shares double, ratio double, holder_rank int, source string, valid_from string, valid_to string")
    position = spark.createDataFrame([(i, rng.randrange(13), code(), f"t{rng.randrange(3)}", rng.choice(["director", "other", "supervisor"]), "s", day(), None) for i in range(90)],
                                     "id bigint, entity_id bigint, stock_code string, title string, title_class string, source string, valid_from string, valid_to string")
    controller = spark.createDataFrame([(i, code(), rng.randrange(13), 10.0 + i, "s", day(), None) for i in range(40)],
                                       "id bigint, stock_code string, entity_id bigint, control_ratio double, source string, valid_from string, valid_to string")
    pairs = spark.createDataFrame([(i, code(), code(), 1.0, "s", day()) for i in range(20)],
                                  "id bigint, subject_code string, counterparty_code string, amount double, source string, event_date string")
    return dict(company=company, entity=entity, holding=holding, position=position, controller=controller, guarantee_pair=pairs)


@pytest.mark.parametrize("change, kw", [({}, {}), ({"R3": {"same_period": False}}, {"as_of": "2020-05-01", "strict_as_of": True})])
def test_counted_runs_equal_runs_of_candidates(crowd, change, kw):
    cfg = rules.config(**change)
    columns = ["subject_code", "party_id", "rule_no", "conf_rank", "n", "score_c", "party_name", "first_path", "last_path", "as_of_date"]
    counted = rules.all_runs(**crowd, cfg=cfg, **kw).withColumns({c: with_attr_maps(F.col(c)) for c in ("first_path", "last_path")})
    got = rows(counted, *columns)
    assert got == rows(folding.runs(rules.all_candidates(**crowd, cfg=cfg, **kw)), *columns) and len({r[2] for r in got}) >= 6


def test_parties_as_of_equal_one_date_at_a_time(spark, crowd):
    from kinweave.operators.as_of import parties_as_of
    dates = ["2020-03-01", "2020-06-15", None]
    asks = spark.createDataFrame([(f"{i:06d}", d) for i in range(6) for d in dates[i % 2:]] + [("000001", "1999-01-01"), ("000002", None), ("777777", "2020-03-01")],
                                 "stock_code string, as_of string")
    columns = ["subject_code", "party_id", "party_name", "rule_id", "confidence", "score_c", "n_candidates", "path"]
    got = {}
    for r in folding.readable(parties_as_of(**crowd, asks=asks)).select("as_of", *columns).collect():
        got.setdefault(r["as_of"], set()).add(tuple(r[1:]))
    for d in [*dates, "1999-01-01"]:
        only = asks.where(F.col("as_of").eqNullSafe(F.lit(d))).select("stock_code")
        want = folding.readable(folding.fold(rules.all_candidates(**crowd, as_of=d, subjects=only))).select(*columns).collect()
        assert got.pop(d) == {tuple(r) for r in want} and want
    assert not got


def test_spread_join_deals_out_and_keeps_pairs(spark, crowd):
    from kinweave.operators.skew import key_shares, spread_join
    left = spark.createDataFrame([(k, i) for i, k in enumerate([0] * 50 + [1] * 9 + [2] * 3 + [None] * 2)], "k int, a int")
    right = spark.createDataFrame([(k, i) for i, k in enumerate([0] * 3 + [1] * 40 + [2] * 2 + [None])], "k int, b int")
    want = sorted((a["a"], b["b"]) for a in left.collect() for b in right.collect() if a["k"] is not None and a["k"] == b["k"])
    for hot in (1, 2, 4, 100):
        assert sorted(tuple(r) for r in spread_join(left, right, ["k"], ["a"], hot_rows=hot).select("a", "b").collect()) == want
    shares = {r["k"]: (r["_rows"], r["_columns"]) for r in key_shares(left, right, ["k"], 4).collect()}
    assert shares == {0: (10, 1), 1: (3, 10)}
    for rule in ("same_control", "chain_director"):
        facts = crowd["controller" if rule == "same_control" else "position"]
        pair = getattr(rules, rule)(facts, crowd["entity"], crowd["company"])
        assert rows(rules.pair_runs(pair, hot_rows=1), "subject_code", "party_id", "n") == rows(rules.pair_runs(pair), "subject_code", "party_id", "n")


def test_key_of_100_000_rows_is_dealt_out(spark):
    """One officer on 100,000 positions, through the normal entry: no task makes much more than its rectangle of pairs."""
    from kinweave.operators import skew
    n = 100_000
    position = spark.range(n).selectExpr("id", "1L AS entity_id", "lpad(cast(id % 50000 as string), 6, '0') AS stock_code", "'t' AS title", "'director' AS title_class",
                                         "'s' AS source", "'2020-01-01' AS valid_from", "cast(null as string) AS valid_to")
    entity = spark.createDataFrame([(1, "P", 0, "high", "p")], "entity_id bigint, display_name string, is_channel int, confidence string, canonical_name string")
    company = spark.createDataFrame([], "stock_code string, short_name string")
    pair = rules.chain_director(position, entity, company)
    shares = skew.key_shares(pair.mine, pair.theirs, ["entity_id"]).first()
    assert (shares["_rows"], shares["_columns"]) == (49, 49)
    few = spark.createDataFrame([(f"{i:06d}",) for i in range(20)], "stock_code string")
    found = rules.pair_runs(rules.chain_director(position, entity, company, subjects=few))
    assert found.groupBy().agg(F.count("*").alias("p"), F.sum("n").alias("n")).first() == (20 * 49_999, 20 * 49_999 * 4)
    met = skew.spread_join(pair.mine.select("entity_id", "id"), pair.theirs.select("entity_id", "o_id"), ["entity_id"], ["id"], right_key=["o_id"])
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "_at" in plan and "_by" in plan


def test_ratio_is_cut_and_not_rounded(spark, tmp_path):
    """10.00 of 100000.01 is 0.9999999 hundredths of a percent, which is none."""
    spark.sql("SELECT * FROM VALUES (1L, 1L, TIMESTAMP'1995-02-01'), (2L, 2L, TIMESTAMP'1995-02-02') o(o_orderkey, o_custkey, o_orderdate)").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("SELECT * FROM VALUES (1L, 7L, 10.0D, 1.0D), (2L, 7L, 99990.01D, 1.0D) l(l_orderkey, l_suppkey, l_extendedprice, l_quantity)").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert rows(Tables(spark, str(tmp_path)).holding, "entity_id", "ratio") == [(1, 0.0), (2, 99.99)]


def test_figures_under_control_are_those_of_all_pairs(spark):
    """Companies under one controller are counted, not paired: shared controllers, equal names, a channel, parties that other rules found too."""
    from kinweave.operators import folding, rules
    from kinweave.plans import evaluation as ev
    codes = [f"{i:06d}" for i in range(1, 9)]
    names = ["甲", "乙", "乙有限公司", "丁", "戊", "己", "庚", "甲股份有限公司"]
    company = spark.createDataFrame(list(zip(codes, names)), "stock_code string, short_name string")
    entity = spark.createDataFrame([(1, 0, "high", "首", "首"), (2, 0, "low", "次", "次"), (3, 1, "high", "通", "通"), (4, 0, "high", "持", "持")],
                                   "entity_id long, is_channel int, confidence string, display_name string, canonical_name string")
    under = [(1, "000001"), (1, "000002"), (1, "000003"), (2, "000003"), (2, "000004"), (2, "000009"), (3, "000005"), (3, "000006"), (1, "000008"), (2, "000001")]
    controller = spark.createDataFrame([(i, c, e, 40.0, "s", "1995-01-01", None) for i, (e, c) in enumerate(under)],
                                       "id long, stock_code string, entity_id long, control_ratio double, source string, valid_from string, valid_to string")
    holding = spark.createDataFrame([(i, 4, c, "1995-03", 1.0, r, 1, "s", "1995-03-01", None) for i, (c, r) in enumerate(
        [("000001", 4.0), ("000002", 6.0), ("000005", 8.0), ("000007", 9.0)])],
        "id long, entity_id long, stock_code string, report_period string, shares double, ratio double, holder_rank int, source string, valid_from string, valid_to string")
    position = spark.createDataFrame([], "id long, entity_id long, stock_code string, title string, title_class string, source string, valid_from string, valid_to string")
    pledge = spark.createDataFrame([(1, "000001", "000002", 1.0, "n", "2024-01-01"), (2, "000001", "000006", 1.0, "n", "2024-01-01"), (3, "000007", "000003", 1.0, "n", "2024-01-01")],
                                   "id long, subject_code string, counterparty_code string, amount double, source string, event_date string")
    gold = spark.createDataFrame([("000001", "乙"), ("000001", "不在"), ("000002", "乙"), ("000003", "丁有限公司"), ("000003", "乙"), ("000008", "甲"), ("000004", "持"),
                                  ("000005", "己"), ("000002", "持"), ("000001", "000006")], "stock_code string, party_name string").selectExpr("*", "'upstream' scope_class")
    facts = (company, entity, holding, position, controller, pledge)
    members, others = rules.control_members(controller, entity, company).cache(), rules.runs_outside_control(*facts).cache()
    everyone = rules.all_runs(*facts).drop("first_path", "last_path")
    want = ev.figures(ev.align(folding.fold_runs(everyone), gold, "upstream"))
    got = ev.figures_under_control(folding.fold_runs(others), members, gold, "upstream")
    assert rows(got, *want.columns) == rows(want, *want.columns)
    # No pair of two companies under one controller is written out.
    assert others.where("subject_code = '000001' AND party_id IN ('C:000002', 'C:000003', 'C:000004', 'C:000008')").count() == 0
