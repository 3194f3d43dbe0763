"""The seven relationship rules, for all subjects in one job.

Every rule gives the same long rows (see COLUMNS). A rule takes `subjects` (a frame with stock_code) to limit the left
side only. `k1`, `k2`, `k3` are the keys of the evidence rows and fix the order of candidates of one pair.
"""
import copy
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from kinweave import settings as S
from kinweave.functions.codes import confidence_rank, valid_at
from kinweave.functions.paths import EVIDENCE_TYPE, HOP_TYPES, flat_hop, make_evidence, make_hop
from kinweave.operators.folding import runs
from kinweave.operators.skew import spread_join

COLUMNS = ["subject_code", "party_id", "party_name", "rule_id", "rule_no", "confidence", "conf_rank", "score_c",
           "k1", "k2", "k3", "path", "evidence", "as_of_date"]


def config(**changes):
    """The default settings with some values changed: config(R1={"related_party": 3.0})."""
    cfg = copy.deepcopy(S.RULES)
    for rule, values in changes.items():
        cfg[rule].update(values)
    return cfg


def _subjects(df, subjects, code="stock_code"):
    if subjects is None:
        return df
    return df.join(subjects.select(F.col("stock_code").alias(code)).distinct(), code, "left_semi")


def _name(display="display_name", canonical="canonical_name"):
    return F.coalesce(F.expr(f"nullif({display}, '')"), F.col(canonical), F.lit(""))


def _entity(entity):
    return entity.select("entity_id", "is_channel", "confidence", "display_name",
                         _name().alias("entity_name"))


def _company(company):
    return company.select(F.col("stock_code").alias("o_code"), F.col("short_name").alias("o_name"))


def _with_other_name(df, company):
    return df.join(_company(company), "o_code", "left").withColumn("o_name", F.coalesce("o_name", "o_code"))


def _out(df, rule, party_id, party_name, confidence, score, k1, k2, path, evidence, as_of, k3="", hop=make_hop):
    return df.select(
        "subject_code", party_id.alias("party_id"), party_name.alias("party_name"), F.lit(rule).alias("rule_id"),
        F.lit(int(rule[1:])).alias("rule_no"), confidence.alias("confidence"),
        confidence_rank(confidence).alias("conf_rank"), score.cast("int").alias("score_c"),
        k1.cast("bigint").alias("k1"), k2.cast("bigint").alias("k2"),
        (F.lit(k3) if isinstance(k3, str) else k3).alias("k3"), path.cast(f"array<{HOP_TYPES[hop]}>").alias("path"),
        evidence.cast(f"array<{EVIDENCE_TYPE}>").alias("evidence"), F.lit(as_of or "").alias("as_of_date"))


def r1_direct(holding, entity, cfg=None, as_of=None, subjects=None, strict_as_of=False, hop=make_hop) -> DataFrame:
    """Holder of a company: by its largest ratio, or by rank where no ratio is disclosed. Holds for all periods."""
    cfg = cfg or S.RULES["R1"]
    rows = _subjects(holding, subjects)
    if strict_as_of:
        rows = rows.where(valid_at("valid_from", "valid_to", as_of))
    per = rows.groupBy("stock_code", "entity_id").agg(
        *[F.max(c).alias(c) for c in ("ratio", "id", "holder_rank", "report_period", "source")])
    ratio, rank = F.col("ratio"), F.col("holder_rank")
    score = (F.when(ratio >= cfg["control"], cfg["control_score"])
             .when(ratio >= cfg["significant"], cfg["significant_score"])
             .when(ratio >= cfg["related_party"], cfg["related_party_score"])
             .when(ratio.isNull() & (rank != 0) & (rank <= cfg["top_rank"]), cfg["top_rank_score"]))
    df = (per.withColumn("score", score).where("score IS NOT NULL")
          .join(_entity(entity).where("is_channel = 0"), "entity_id").withColumn("subject_code", F.col("stock_code")))
    step = hop(F.col("entity_name"), F.col("subject_code"), "HOLDS", ratio=ratio, rank=rank,
               period=F.col("report_period"), source=F.col("source"))
    proof = make_evidence("holding", F.col("id"), F.col("source"), F.col("report_period"),
                          entity_id=F.col("entity_id"), ratio=ratio, rank=rank)
    return _out(df, "R1", F.concat(F.lit("E:"), F.col("entity_id").cast("string")), F.col("entity_name"),
                F.when(ratio.isNull(), "medium").otherwise("high"), F.col("score"), F.col("id"), F.lit(0),
                F.array(step), F.array(proof), as_of, hop=hop)


def _other(df, **columns):
    """The same facts as the other side of a pair, every column renamed."""
    return df.select(*[F.col(c).alias(a) for a, c in columns.items()])


class PairRule(NamedTuple):
    """A rule that pairs companies over a shared holder, controller or officer. With a range its facts keep their valid_from.

    mine: one row per fact of the subject with keys, heads (facts of the entity), subject_code, id and own details. theirs: the same of the
    other company with o_code, o_id and details. Every fact of one side meets every fact of the other under equal keys.
    """
    rule: str
    mine: DataFrame
    theirs: DataFrame
    keys: list
    heads: list
    own: list
    other: list
    confidence: Column
    score: int
    path: Callable
    evidence: Callable
    company: DataFrame
    as_of: str | None
    #: Keys that a pair is also counted by.
    by: list = []
    #: What a path shows besides the codes: the name of the entity, and a detail of either side.
    shown: tuple = ()


def _ends(pair: PairRule):
    """Both sides of a pair rule by key and company: the number of facts, the first and the last."""
    def ends(df, by, key, details):
        fact = F.struct(key, *details)
        return df.groupBy(*by).agg(F.count("*").alias(f"{key}_n"), F.min_by(fact, key).alias(f"{key}_first"), F.max_by(fact, key).alias(f"{key}_last"))
    return ends(pair.mine, [*pair.keys, *pair.heads, "subject_code"], "id", pair.own), ends(pair.theirs, [*pair.keys, "o_code"], "o_id", pair.other)


def _rows_of(pair: PairRule, hot_rows):
    """All candidates of a pair rule, one for each pair of facts."""
    df = spread_join(pair.mine, pair.theirs, pair.keys, ["id"], hot_rows=hot_rows, right_key=["o_id"]).where("o_code <> subject_code")
    df = _with_other_name(df, pair.company)
    return _out(df, pair.rule, F.concat(F.lit("C:"), "o_code"), F.col("o_name"), pair.confidence, F.lit(pair.score), F.col("id"), F.col("o_id"),
                pair.path(make_hop), pair.evidence(), pair.as_of)


def pair_runs(pair: PairRule, hot_rows=None) -> DataFrame:
    """The runs of a pair rule (see folding.runs), counted before its facts are joined.

    Under one key all facts of the subject meet all of the other company, so n x m candidates follow from the two counts, the first one
    from the first fact of each side and the last one from the last. What is joined is one row per key and company with two facts each;
    paths are made from the first and last facts of a pair once its keys are summed up.
    """
    mine, theirs = _ends(pair)
    met = spread_join(mine, theirs, pair.keys, ["subject_code"], hot_rows=hot_rows, right_key=["o_code"]).where("o_code <> subject_code")

    def step(end):
        facts = [*[F.col(f"id_{end}.{c}").alias(c) for c in ("id", *pair.own)], *[F.col(f"o_id_{end}.{c}").alias(c) for c in ("o_id", *pair.other)]]
        return F.struct(*facts, *[c for c in (*pair.keys, *pair.heads)]), F.struct(f"id_{end}.id", f"o_id_{end}.o_id")
    runs = met.withColumn("conf", confidence_rank(pair.confidence)).groupBy("subject_code", "o_code", *pair.by, "conf").agg(
        F.sum(F.col("id_n") * F.col("o_id_n")).alias("n"), F.min_by(*step("first")).alias("_first"), F.max_by(*step("last")).alias("_last"))

    def path_of(df, end, name):
        flat = df.withColumns({c: F.col(f"{end}.{c}") for c in ("id", *pair.own, "o_id", *pair.other, *pair.keys, *pair.heads) if c not in pair.by})
        return flat.withColumn(name, pair.path(flat_hop).cast(f"array<{HOP_TYPES[flat_hop]}>"))
    runs = path_of(path_of(runs, "_first", "first_path"), "_last", "last_path").select("subject_code", "o_code", *pair.by, "conf", "n", "first_path", "last_path")
    return _with_other_name(runs, pair.company).select(
        "subject_code", *pair.by, F.concat(F.lit("C:"), "o_code").alias("party_id"), F.lit(int(pair.rule[1:])).alias("rule_no"), F.col("conf").alias("conf_rank"), "n",
        F.lit(pair.score).cast("int").alias("score_c"), F.col("o_name").alias("party_name"), "first_path", "last_path", F.lit(pair.as_of or "").alias("as_of_date"))


def same_control(controller, entity, company, cfg=None, as_of=None, subjects=None, strict_as_of=False, with_range=False) -> PairRule:
    cfg = cfg or S.RULES["R2"]
    until = "valid_to" if strict_as_of else None
    live = controller.where(valid_at("valid_from", until, as_of))
    heads = _entity(entity).where("is_channel = 0").select("entity_id", "entity_name")
    dated = ["valid_from"] if with_range else []
    mine = _subjects(live, subjects).join(heads, "entity_id").select(
        "entity_id", "entity_name", F.col("stock_code").alias("subject_code"), "id", "control_ratio", "source", *dated)
    theirs = _other(live, entity_id="entity_id", o_id="id", o_code="stock_code", o_source="source", **{c: c for c in dated})
    head = F.col("entity_name")
    return PairRule(
        "R2", mine, theirs, ["entity_id"], ["entity_name"], ["control_ratio", "source"], ["o_source"], F.lit("high"), cfg["score"],
        lambda hop: F.array(hop(F.col("subject_code"), head, "CONTROLLED_BY", ratio=F.col("control_ratio")),
                            hop(head, F.col("o_code"), "CONTROLS", source=F.col("o_source"))),
        lambda: F.array(make_evidence("actual_controller", F.col("id"), F.col("source"), controller=head, entity_id=F.col("entity_id")),
                        make_evidence("actual_controller", F.col("o_id"), F.col("o_source"), brother=F.col("o_code"))), company, as_of,
        shown=("entity_name", "control_ratio", "o_source"))


def r2_same_control(controller, entity, company, cfg=None, as_of=None, subjects=None, strict_as_of=False, hot_rows=None):
    """Companies under one controller that is not itself only a channel."""
    return _rows_of(same_control(controller, entity, company, cfg, as_of, subjects, strict_as_of), hot_rows)


def common_holder(holding, entity, company, cfg=None, as_of=None, subjects=None, strict_as_of=False) -> PairRule:
    cfg = cfg or S.RULES["R3"]
    large = holding.where(F.col("ratio") >= cfg["min_ratio"])
    if strict_as_of:
        large = large.where(valid_at("valid_from", "valid_to", as_of))
    names = _entity(entity).where("is_channel = 0").select("entity_id", "entity_name")
    same = cfg["same_period"]
    mine = _subjects(large, subjects).join(names, "entity_id").select(
        "entity_id", "entity_name", "report_period", F.col("stock_code").alias("subject_code"), "id", "ratio", "source")
    theirs = large.select("entity_id", *(["report_period"] if same else []),
                          F.col("report_period").alias("o_period"), F.col("id").alias("o_id"),
                          F.col("stock_code").alias("o_code"), F.col("ratio").alias("o_ratio"), F.col("source").alias("o_source"))
    x = F.col("entity_name")
    return PairRule(
        "R3", mine, theirs, ["entity_id", "report_period"] if same else ["entity_id"], ["entity_name"],
        ["ratio", "source"] if same else ["ratio", "source", "report_period"], ["o_period", "o_ratio", "o_source"], F.lit("low"), cfg["score"],
        lambda hop: F.array(hop(F.col("subject_code"), x, "HELD_BY", ratio=F.col("ratio"), period=F.col("report_period")),
                            hop(x, F.col("o_code"), "HOLDS", ratio=F.col("o_ratio"), period=F.col("o_period"))),
        lambda: F.array(make_evidence("holding", F.col("id"), F.col("source"), F.col("report_period"), entity_id=F.col("entity_id")),
                        make_evidence("holding", F.col("o_id"), F.col("o_source"), F.col("o_period"), brother=F.col("o_code"))), company, as_of,
        shown=("entity_name", "ratio", "o_ratio"))


def r3_common_holder(holding, entity, company, cfg=None, as_of=None, subjects=None, strict_as_of=False, hot_rows=None):
    """Companies with a common holder above the threshold on both sides, in the same period by default."""
    return _rows_of(common_holder(holding, entity, company, cfg, as_of, subjects, strict_as_of), hot_rows)


def chain_director(position, entity, company, cfg=None, as_of=None, subjects=None, strict_as_of=False, with_range=False) -> PairRule:
    cfg = cfg or S.RULES["R4"]
    until = "valid_to" if strict_as_of else None
    live = position.where(valid_at("valid_from", until, as_of))
    people = _entity(entity).where("is_channel = 0").select(
        "entity_id", F.coalesce("confidence", F.lit("medium")).alias("person_conf"),
        F.coalesce("display_name", F.lit("")).alias("person"))
    dated = ["valid_from"] if with_range else []
    mine = _subjects(live.where(F.col("title_class").isin(cfg["title_classes"])), subjects).join(people, "entity_id").select(
        "entity_id", "person", "person_conf", F.col("stock_code").alias("subject_code"), "id", "title", "title_class", "source", *dated)
    theirs = _other(live, entity_id="entity_id", o_id="id", o_code="stock_code", o_title="title", o_class="title_class",
                    o_source="source", **{c: c for c in dated})
    who = F.col("person")
    return PairRule(
        "R4", mine, theirs, ["entity_id"], ["person", "person_conf"], ["title", "title_class", "source"], ["o_title", "o_class", "o_source"],
        F.col("person_conf"), cfg["score"],
        lambda hop: F.array(hop(F.col("subject_code"), who, "SERVED_BY", title=F.col("title"), title_class=F.col("title_class")),
                            hop(who, F.col("o_code"), "SERVES_AS", title=F.col("o_title"), title_class=F.col("o_class"))),
        lambda: F.array(make_evidence("position", F.col("id"), F.col("source"), entity_id=F.col("entity_id"), title=F.col("title")),
                        make_evidence("position", F.col("o_id"), F.col("o_source"), brother=F.col("o_code"), title=F.col("o_title"))), company, as_of,
        shown=("person", "title", "o_title"))


def r4_chain_director(position, entity, company, cfg=None, as_of=None, subjects=None, strict_as_of=False, hot_rows=None):
    """Companies sharing an officer; the officer's title counts on the subject's side only. Never surer than the person."""
    return _rows_of(chain_director(position, entity, company, cfg, as_of, subjects, strict_as_of), hot_rows)


def key_person(position, holding, entity, company, cfg=None, as_of=None, subjects=None, strict_as_of=False, with_range=False) -> PairRule:
    cfg = cfg or S.RULES["R5"]
    until = "valid_to" if strict_as_of else None
    officers = position.where(F.col("title_class").isin(cfg["title_classes"]) & valid_at("valid_from", until, as_of))
    large = holding.where(F.col("ratio") >= cfg["min_ratio"])
    if strict_as_of:
        large = large.where(valid_at("valid_from", "valid_to", as_of))
    names = _entity(entity).select("entity_id", "entity_name")
    mine = _subjects(officers, subjects).join(names, "entity_id", "left").select(
        "entity_id", F.coalesce("entity_name", F.lit("")).alias("person"), F.col("stock_code").alias("subject_code"),
        "id", "title", "source", *(["valid_from"] if with_range else []))
    theirs = _other(large, entity_id="entity_id", o_id="id", o_code="stock_code", o_ratio="ratio", o_period="report_period",
                    o_source="source")
    who = F.col("person")
    return PairRule(
        "R5", mine, theirs, ["entity_id"], ["person"], ["title", "source"], ["o_ratio", "o_period", "o_source"], F.lit("high"), cfg["score"],
        lambda hop: F.array(hop(F.col("subject_code"), who, "SERVED_BY", title=F.col("title")),
                            hop(who, F.col("o_code"), "HOLDS", ratio=F.col("o_ratio"), period=F.col("o_period"))),
        lambda: F.array(make_evidence("position", F.col("id"), F.col("source"), entity_id=F.col("entity_id")),
                        make_evidence("holding", F.col("o_id"), F.col("o_source"), F.col("o_period"), brother=F.col("o_code"),
                                      ratio=F.col("o_ratio"))), company, as_of,
        shown=("person", "title", "o_ratio"))


def r5_key_person(position, holding, entity, company, cfg=None, as_of=None, subjects=None, strict_as_of=False, hot_rows=None):
    """Companies of which an officer of the subject holds at least the threshold, in any period."""
    return _rows_of(key_person(position, holding, entity, company, cfg, as_of, subjects, strict_as_of), hot_rows)


def ownership_chains(holding, entity, company, max_hops=3, min_ratio=5.0, subjects=None, by_edge_max=False) -> DataFrame:
    """Chains of holdings above a company, 2..max_hops long, whose product of ratios is at least min_ratio percent.

    A chain below the threshold can never come back (ratios are at most 100 %), so it is dropped at every hop; what
    travels to the next join is only what may still count. The number of joins is the hop bound.
    Columns: target_code, entity_id, prod, hops, edge_ids (array).
    """
    edges = holding.where("ratio IS NOT NULL").select("entity_id", "stock_code", "ratio", "id")
    if by_edge_max:
        edges = edges.groupBy("entity_id", "stock_code").agg(F.max("ratio").alias("ratio"), F.max_by(
            "id", F.struct("ratio", "id")).alias("id"))
    step = (edges.where(F.col("ratio") >= min_ratio).join(entity.where("is_channel = 1").select("entity_id"), "entity_id", "left_anti")
            .select(F.col("stock_code").alias("via"), F.col("entity_id").alias("up"), F.col("ratio").alias("up_ratio"),
                    F.col("id").alias("up_id")))
    listed = company.groupBy(F.col("short_name").alias("n")).agg(F.min("stock_code").alias("via"))
    listed = entity.select("entity_id", F.col("display_name").alias("n")).join(listed, "n").select("entity_id", "via")
    chain = _subjects(edges, subjects).where(F.col("ratio") >= min_ratio).select(
        F.col("stock_code").alias("target_code"), "entity_id", F.col("ratio").alias("prod"), F.lit(1).alias("hops"),
        F.array("id").alias("edge_ids"))
    found = None
    for hop in range(2, max_hops + 1):
        chain = (chain.join(listed, "entity_id").join(step, "via")
                 .withColumn("prod", F.col("prod") * (F.col("up_ratio") / F.lit(100.0))).where(F.col("prod") >= min_ratio)
                 .select("target_code", F.col("up").alias("entity_id"), "prod", F.lit(hop).alias("hops"),
                         F.array_append("edge_ids", F.col("up_id")).alias("edge_ids")))
        found = chain if found is None else found.unionAll(chain)
    return found


def r6_penetrate(holding, entity, company, cfg=None, as_of=None, subjects=None, strict_as_of=False, latest_period_only=False,
                 limit=None, hop=make_hop):
    """Indirect holders through listed companies. `limit` keeps the strongest chains of each subject (off by default)."""
    from pyspark.sql import Window
    cfg = cfg or S.RULES["R6"]
    rows = holding
    if strict_as_of:
        rows = rows.where(valid_at("valid_from", "valid_to", as_of))
    if latest_period_only:
        last = rows.groupBy("stock_code").agg(F.max("report_period").alias("report_period"))
        rows = rows.join(last, ["stock_code", "report_period"], "left_semi")
    df = ownership_chains(rows, entity, company, cfg["max_hops"], cfg["min_effective_ratio"], subjects)
    if limit:
        order = Window.partitionBy("target_code").orderBy(F.desc("prod"), "edge_ids")
        df = df.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= limit).drop("_rn")
    names = _entity(entity).select("entity_id", "entity_name")
    df = df.join(names, "entity_id", "left").withColumnRenamed("target_code", "subject_code")
    effective = F.round("prod", 4)
    ids = F.array_join(F.col("edge_ids").cast("array<string>"), ">")
    path = F.array(hop(F.col("entity_name"), F.col("subject_code"), F.concat(F.lit("HOLDS*"), F.col("hops").cast("string")),
                       effective_ratio=effective))
    proof = F.array(make_evidence("holding", 0, "chain", None, holder_eid=F.col("entity_id"), effective_ratio=effective,
                                  hops=F.col("hops"), edge_ids=ids))
    return _out(df, "R6", F.concat(F.lit("E:"), F.col("entity_id").cast("string")), F.col("entity_name"), F.lit("high"),
                F.lit(cfg["score"]), F.col("edge_ids")[0], F.element_at("edge_ids", -1), path, proof, as_of, k3=ids, hop=hop)


def r7_event(guarantee_pair, cfg=None, as_of=None, subjects=None, one_direction=False, hop=make_hop):
    """Parties of pairwise guarantees, in both directions; one_direction keeps only the guarantor's view."""
    cfg = cfg or S.RULES["R7"]
    rows = guarantee_pair.select("id", "subject_code", F.col("counterparty_code").alias("o_code"), "amount", "source", "event_date")
    both = rows.where("o_code <> subject_code")
    if not one_direction:
        both = both.unionAll(both.select("id", F.col("o_code").alias("subject_code"), F.col("subject_code").alias("o_code"),
                                         "amount", "source", "event_date"))
    df = _subjects(both.where("o_code IS NOT NULL AND o_code <> ''"), subjects, "subject_code")
    proof = F.array(make_evidence("guarantee_pair", F.col("id"), F.col("source"), F.col("event_date"), amount=F.col("amount")))
    return _out(df, "R7", F.concat(F.lit("C:"), "o_code"), F.col("o_code"), F.lit("high"), F.lit(cfg["score"]), F.col("id"),
                F.lit(0), F.array(), proof, as_of, hop=hop)


def _union_of(plans, cfg):
    out = None
    for rule, plan in plans.items():
        df = plan(cfg[rule]) if cfg[rule].get("enabled", True) else None
        if df is not None:
            out = df if out is None else out.unionByName(df)
    return out


def all_candidates(company, entity, holding, position, controller, guarantee_pair=None, cfg=None, as_of=None, subjects=None,
                   strict_as_of=False) -> DataFrame:
    """Candidates of all enabled rules."""
    kw = {"as_of": as_of, "subjects": subjects}
    st = {**kw, "strict_as_of": strict_as_of}
    return _union_of({
        "R1": lambda c: r1_direct(holding, entity, c, **st),
        "R2": lambda c: r2_same_control(controller, entity, company, c, **st),
        "R3": lambda c: r3_common_holder(holding, entity, company, c, **st),
        "R4": lambda c: r4_chain_director(position, entity, company, c, **st),
        "R5": lambda c: r5_key_person(position, holding, entity, company, c, **st),
        "R6": lambda c: r6_penetrate(holding, entity, company, c, **st),
        "R7": lambda c: r7_event(guarantee_pair, c, **kw) if guarantee_pair is not None else None,
    }, cfg or S.RULES)


def all_runs(company, entity, holding, position, controller, guarantee_pair=None, cfg=None, as_of=None, subjects=None,
             strict_as_of=False) -> DataFrame:
    """Runs of all enabled rules for folding.fold_runs: those of the pair rules are counted before their joins.
    Paths have flat hops."""
    kw = {"as_of": as_of, "subjects": subjects}
    st = {**kw, "strict_as_of": strict_as_of}
    return _union_of({
        "R1": lambda c: runs(r1_direct(holding, entity, c, hop=flat_hop, **st)),
        "R2": lambda c: pair_runs(same_control(controller, entity, company, c, **st)),
        "R3": lambda c: pair_runs(common_holder(holding, entity, company, c, **st)),
        "R4": lambda c: pair_runs(chain_director(position, entity, company, c, **st)),
        "R5": lambda c: pair_runs(key_person(position, holding, entity, company, c, **st)),
        "R6": lambda c: runs(r6_penetrate(holding, entity, company, c, hop=flat_hop, **st)),
        "R7": lambda c: runs(r7_event(guarantee_pair, c, hop=flat_hop, **kw)) if guarantee_pair is not None else None,
    }, cfg or S.RULES)


def control_members(controller, entity, company) -> DataFrame:
    """Companies under each controller that is no channel, one row each: what rule R2 pairs, before it is paired. Columns: entity_id, stock_code, name."""
    under = same_control(controller, entity, company).mine.select("entity_id", F.col("subject_code").alias("o_code")).distinct()
    return _with_other_name(under, company).select("entity_id", F.col("o_code").alias("stock_code"), F.col("o_name").alias("name"))


def outside_control(run_rows, members) -> DataFrame:
    """Runs (without R2's) of the pairs that are not two companies under one controller. Only pairs that another rule found are looked up."""
    of = lambda code, name: members.groupBy(F.col("stock_code").alias(code)).agg(F.collect_set("entity_id").alias(name))
    rows = run_rows.where("rule_no <> 2").withColumn("_o", F.when(F.col("party_id").startswith("C:"), F.expr("substring(party_id, 3)")))
    both = rows.join(of("subject_code", "_mine"), "subject_code", "left").join(of("_o", "_theirs"), "_o", "left")
    return both.where(~F.coalesce(F.arrays_overlap("_mine", "_theirs"), F.lit(False))).select(*run_rows.columns)


def runs_outside_control(company, entity, holding, position, controller, guarantee_pair=None) -> DataFrame:
    """The runs of all rules but R2, without paths, of pairs that are not two companies under one controller: these grow with the facts."""
    runs = all_runs(company, entity, holding, position, controller, guarantee_pair, config(R2={"enabled": False}))
    return outside_control(runs.drop("first_path", "last_path"), control_members(controller, entity, company))
