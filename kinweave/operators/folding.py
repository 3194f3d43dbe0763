"""Folding of candidates into one row per (subject, party).

Candidates of a pair are folded in the order rule, confidence (highest first), evidence keys. Within one rule and
confidence all candidates score the same (the direct-holding rule gives one per pair), so a run of n of them is one
step: the first may raise the confidence, each further one adds the bonus. That makes the fold a count per run, taken by
partial aggregation before the shuffle; at most 7 x 3 runs per pair are left to fold, however many candidates a pair has.
"""
from pyspark.sql import DataFrame, Window, functions as F

from kinweave import settings as S
from kinweave.functions.paths import HOP_TYPE, shown_path

_STATE = "struct<conf:int,score:int,name:string>"


def runs(candidates: DataFrame, keys=("subject_code", "party_id"), paths=True) -> DataFrame:
    """Runs of equal candidates, counted. Without paths where only names and confidences are asked for."""
    order = F.struct("k1", "k2", "k3")
    return candidates.groupBy(*keys, "rule_no", "conf_rank").agg(
        F.count("*").alias("n"), F.max("score_c").alias("score_c"),
        (F.min_by("party_name", order) if paths else F.min("party_name")).alias("party_name"),
        *([F.min_by("path", order).alias("first_path"), F.max_by("path", order).alias("last_path")] if paths else []),
        F.first("as_of_date").alias("as_of_date"))


def _step(state, run):
    bonus = S.REPEAT_BONUS
    raised = run["conf_rank"] > state["conf"]
    started = state["conf"].isNotNull()
    first = (F.when(~started, run["score_c"])
             .when(raised, F.least(F.lit(100), F.greatest(state["score"], run["score_c"]) + bonus))
             .otherwise(F.least(F.lit(100), state["score"] + bonus)))
    taken = ~started | raised
    return F.struct(
        F.when(taken, run["conf_rank"]).otherwise(state["conf"]).cast("int").alias("conf"),
        F.least(F.lit(100), first + bonus * (run["n"] - 1)).cast("int").alias("score"),
        F.when(taken, run["party_name"]).otherwise(state["name"]).alias("name"))


def _single(run):
    """The state after a run that is the only one of its pair."""
    score = F.least(F.lit(100), run["score_c"] + S.REPEAT_BONUS * (run["n"] - 1))
    return F.struct(run["conf_rank"].cast("int").alias("conf"), score.cast("int").alias("score"), run["party_name"].alias("name")).cast(_STATE)


def fold(candidates: DataFrame, keys=("subject_code", "party_id")) -> DataFrame:
    """One row per pair: merged rule ids, final confidence and score, first and last hop, number of candidates."""
    return fold_runs(runs(candidates, keys), keys)


def fold_runs(run_rows: DataFrame, keys=("subject_code", "party_id")) -> DataFrame:
    """The fold over runs already counted, so that several settings can share one count."""
    return fold_gathered(gather(run_rows, keys), keys)


def gather(run_rows: DataFrame, keys=("subject_code", "party_id")) -> DataFrame:
    """The runs of each pair as an array r in folding order."""
    paths = [c for c in ("first_path", "last_path") if c in run_rows.columns]
    grouped = run_rows.groupBy(*keys).agg(F.collect_list(F.struct(
        "rule_no", (-F.col("conf_rank")).alias("o"), "conf_rank", "n", "score_c", "party_name", *paths, "as_of_date")).alias("r"))
    return grouped.withColumn("r", F.when(F.size("r") == 1, F.col("r")).otherwise(F.array_sort("r", lambda a, b: F.when(
        a["rule_no"] != b["rule_no"], a["rule_no"] - b["rule_no"]).otherwise(a["o"] - b["o"]))))


def fold_gathered(grouped: DataFrame, keys=("subject_code", "party_id")) -> DataFrame:
    """The fold over gathered runs."""
    none = F.lit(None).cast(f"array<{HOP_TYPE}>")
    first, last = F.col("r")[0], F.element_at("r", -1)

    def path(total):
        if "first_path" not in grouped.schema["r"].dataType.elementType.names:
            return none
        return F.when(total == 1, first["first_path"]).otherwise(F.concat(F.slice(first["first_path"], 1, 1), F.slice(last["last_path"], 1, 1)))
    return fold_steps(grouped, keys, path, first["as_of_date"])


def fold_steps(grouped: DataFrame, keys, path, as_of_date) -> DataFrame:
    """The fold over an array r of runs in folding order. path: from the number of candidates to their path.

    Most pairs have one run, for which nothing is stepped through.
    """
    one, only = F.size("r") == 1, F.col("r")[0]
    start = F.struct(F.lit(None).cast("int").alias("conf"), F.lit(0).alias("score"), F.lit("").alias("name")).cast(_STATE)
    rule = lambda x: F.concat(F.lit("R"), x["rule_no"].cast("string"))
    rule_ids = F.when(one, rule(only)).otherwise(F.array_join(F.array_distinct(F.transform("r", rule)), "+"))
    total = F.when(one, only["n"]).otherwise(F.aggregate("r", F.lit(0).cast("bigint"), lambda a, x: a + x["n"]))
    state = F.when(one, _single(only)).otherwise(F.aggregate("r", start, _step))
    rows = grouped.select("*", state.alias("s"), rule_ids.alias("rule_id"), total.alias("n_candidates"))
    return _folded(rows, keys, path(F.col("n_candidates")), as_of_date)


def _folded(df, keys, path, as_of_date):
    conf = F.col("s.conf")
    return df.select(
        *keys, F.col("s.name").alias("party_name"), "rule_id",
        F.when(conf == 3, "high").when(conf == 2, "medium").when(conf == 1, "low").alias("confidence"),
        (F.col("s.score") / F.lit(100.0)).alias("score"), F.col("s.score").alias("score_c"), path.alias("path"),
        "n_candidates", as_of_date.alias("as_of_date"))


def fold_single(run_rows: DataFrame, keys=("subject_code", "party_id")) -> DataFrame:
    """The fold over runs that are known to be the only ones of their pairs, row by row."""
    rows = run_rows.select("*", _single({c: F.col(c) for c in ("score_c", "n", "conf_rank", "party_name")}).alias("s"),
                           F.concat(F.lit("R"), F.col("rule_no").cast("string")).alias("rule_id"), F.col("n").alias("n_candidates"))
    path = F.lit(None).cast(f"array<{HOP_TYPE}>")
    if "first_path" in run_rows.columns:
        path = F.when(F.col("n") == 1, F.col("first_path")).otherwise(F.concat(F.slice("first_path", 1, 1), F.slice("last_path", 1, 1)))
    return _folded(rows, keys, path, F.col("as_of_date"))


def candidate_evidence(candidates: DataFrame) -> DataFrame:
    """Evidence of every pair as rows, in folding order. Long form, so a pair with many candidates stays many rows."""
    return candidates.select("subject_code", "party_id", "rule_no", "conf_rank", "k1", "k2", "k3",
                             F.posexplode("evidence").alias("part", "e")).select(
        "subject_code", "party_id", "rule_no", "conf_rank", "k1", "k2", "k3", "part", "e.*")


def leading_evidence(candidates: DataFrame, n: int) -> DataFrame:
    """First n pieces of evidence per pair as one array; the row limit is pushed below the shuffle."""
    order = Window.partitionBy("subject_code", "party_id").orderBy("rule_no", F.desc("conf_rank"), "k1", "k2", "k3", "part")
    rows = candidate_evidence(candidates).withColumn("at", F.row_number().over(order)).where(F.col("at") <= n)
    return rows.groupBy("subject_code", "party_id").agg(
        F.array_sort(F.collect_list(F.struct("at", "table", "pk", "source", "report_period"))).alias("evidence"))


def readable(folded: DataFrame) -> DataFrame:
    return folded.withColumn("path", shown_path(folded))


def rule_statistics(folded: DataFrame) -> DataFrame:
    """Hits and confidences per rule, merged ids counted for each of their rules."""
    rows = folded.select(F.explode(F.array_distinct(F.split("rule_id", r"\+"))).alias("rule_id"), "confidence", "subject_code")
    return rows.groupBy("rule_id").agg(
        F.count("*").alias("hits"), *[F.count_if(F.col("confidence") == c).alias(c) for c in ("high", "medium", "low")])


def candidate_statistics(folded: DataFrame) -> DataFrame:
    per = folded.groupBy("subject_code").agg(F.count("*").alias("n"), *[
        F.count_if(F.col("confidence") == c).alias(c) for c in ("high", "medium", "low")])
    return per.groupBy().agg(
        F.count("*").alias("n_companies"), F.sum("n").alias("n_candidates"),
        *[F.sum(c).alias(c) for c in ("high", "medium", "low")],
        F.floor(F.sum("n") * 1000 / F.count("*")).cast("bigint").alias("mean_per_company_milli"))
