"""Parties without a stored row per pair under one controller."""
from pyspark.sql import functions as F

from kinweave.operators import folding, found, rules
from kinweave.operators.skew import may_be_hot, paired_except
from tests.conftest import rows
from tests.test_rules import crowd  # noqa: F401

COLUMNS = ("subject_code", "party_id", "party_name", "rule_id", "confidence", "score_c", "n_candidates", "as_of_date")


def test_met_and_alone_are_all_parties(crowd):
    """Companies with several controllers, repeated facts of control, parties that go by a code: the two parts are disjoint and make the fold of all runs."""
    c = {k: crowd[k] for k in ("company", "entity", "controller")}
    crowd = {**crowd, **{k: crowd[k].where("id % 5 = 0") for k in ("holding", "position")}, "guarantee_pair": crowd["guarantee_pair"].where("id < 6")}
    want = folding.readable(folding.fold_runs(rules.all_runs(**crowd)))
    for paths, columns in ((True, (*COLUMNS, "path")), (False, COLUMNS)):
        met = found.met(**crowd, paths=paths).cache()
        alone = found.alone(**c, known=found.by_control(met), paths=paths).cache()
        got = met.unionByName(alone)
        assert rows(folding.readable(got) if paths else got, *columns) == rows(want, *columns)
        assert {r[0] for r in alone.select("rule_id").distinct().collect()} == {"R2"} and met.where("rule_id = 'R2'").count() == 0
    # All pairs under control, as if no other rule had found any.
    pairs = rows(found.alone(**c, known=met.limit(0), paths=True), "subject_code", "party_id", "n_candidates", "path")
    assert pairs == rows(folding.fold_runs(rules.all_runs(**crowd).where("rule_no = 2")).withColumn("path", F.transform("path", lambda h: F.concat(
        h["frm"], F.lit(" -"), h["edge"], F.coalesce(F.concat(F.lit(" ["), h["attrs"]["ratio"], F.lit("%]")), F.lit("")), F.lit("-> "), h["to"]))),
        "subject_code", "party_id", "n_candidates", "path")


def test_pairs_but_known_ones(spark):
    left = spark.createDataFrame([(k, a) for k in "xy" for a in range(7)] + [(None, 1)], "k string, a int")
    right = spark.createDataFrame([(k, b) for k in "xz" for b in range(5)] + [(None, 1)], "k string, b int")
    known = spark.createDataFrame([("x", 1, 1), ("x", 1, 4), ("x", 6, 0), ("y", 2, 2)], "k string, a int, b int")
    want = sorted(("x", a, b) for a in range(7) for b in range(5) if (a, b) not in {(1, 1), (1, 4), (6, 0)})
    for side in (2, 100):
        assert sorted(tuple(r) for r in paired_except(left, right, ["k"], "a", "b", known, side).select("k", "a", "b").collect()) == want
    assert may_be_hot(left, right, ["k"], hot_rows=5) and not may_be_hot(left, right, ["k"], hot_rows=50)


def test_alignment_ablation_and_shared_names_are_those_of_all_pairs(spark, crowd, monkeypatch):
    """Names under control that are also found outside it, disclosed or borne by several companies; no pair under control is folded for them."""
    from kinweave.operators import summaries
    from kinweave.plans import evaluation as ev
    crowd = {**crowd, **{k: crowd[k].where("id % 5 = 0") for k in ("holding", "position")}, "guarantee_pair": crowd["guarantee_pair"].where("id < 6")}
    crowd["company"] = crowd["company"].withColumn("short_name", F.when(F.col("stock_code") == "000004", "C2").otherwise(F.col("short_name")))
    gold = spark.createDataFrame([(f"{i:06d}", n) for i in range(8) for n in ("C2", "C5", "P1", "不在", "000003")[i % 3:]], "stock_code string, party_name string").selectExpr(
        "*", "if(party_name = 'P1', 'other', 'upstream') scope_class")
    runs = rules.all_runs(**crowd).drop("first_path", "last_path").cache()
    everyone = folding.fold_runs(runs).cache()
    pairs = found.pairs_met(**crowd).cache()
    members = rules.control_members(crowd["controller"], crowd["entity"], crowd["company"]).cache()
    outside = found.folded(pairs.where("c_n = 0"), crowd["company"]).cache()
    names = ("stock_code", "name", "side")
    want = rows(ev.align(everyone, gold, "upstream"), *names)
    assert rows(ev.align_under_control(outside, members, gold, "upstream"), *names) == want and {r[2] for r in want} == {"matched", "gold_only", "system_only"}
    got = ev.rule_ablation(pairs, crowd["company"], members, gold)
    for r in (1, 2, 3, 4):
        one = ev.figures(ev.align(folding.fold_runs(runs.where(F.col("rule_no") != r)), gold, "upstream"))
        assert rows(got.where(F.col("setting") == f"R{r}"), *one.columns) == rows(one, *one.columns)
    following = spark.createDataFrame([(f"{i:06d}", f"{j:06d}") for i in range(9) for j in range(9)], "a string, b string")
    assert rows(ev.shared_names(outside, members, following), "a", "b", "name") == rows(summaries.shared_names(everyone, following), "a", "b", "name")


def test_review_order_sorts_only_the_met(spark):
    from kinweave.operators import summaries
    parties = lambda xs: spark.createDataFrame([(str(i), *x) for i, x in enumerate(xs)], "party_id string, rule_id string, confidence string, score_c int")
    met = parties([("R3", "low", 30), ("R2+R7", "high", 100), ("R2+R3", "high", 95), ("R1", "high", 95), ("R2", "high", 40), ("R9", "low", 90), ("R2+R4", "high", 90)])
    alone = parties([("R2", "high", 90), ("R2", "high", 100), ("R2", "high", 90)])
    key = ("rule_order", "conf_order", "score_c")
    got = [tuple(r) for r in summaries.review_order_of(met, alone, found.scores_alone()).select(*key).collect()]
    assert got == [tuple(r) for r in summaries.review_order(met.unionAll(alone)).select(*key).collect()] and len(got) == 10
