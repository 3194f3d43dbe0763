"""Rules R1-R7, their fold and their statistics."""
from pyspark.sql import functions as F

from kinweave.catalog import rulesql as r
from kinweave.catalog.registry import query
from kinweave.functions.paths import render_path
from kinweave.operators import folding, rules

_COLS = ["subject_code", "party_id", "party_name", "confidence", "score_c", "k1", "k2", "path"]


def _flat(df):
    return df.withColumn("path", render_path("path")).select(*_COLS)


def _sql(i):
    return (f"SELECT subject_code, party_id, party_name, CASE conf WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END confidence, "
            f"score score_c, CAST(k1 AS BIGINT) k1, CAST(k2 AS BIGINT) k2, p path FROM c{i}")


query("R1", _sql(1), r.CTES)(lambda t: _flat(rules.r1_direct(t.holding, t.entity)))
query("R2", _sql(2), r.CTES)(lambda t: _flat(rules.r2_same_control(t.controller, t.entity, t.company)))
query("R3", _sql(3), r.CTES)(lambda t: _flat(rules.r3_common_holder(t.holding, t.entity, t.company)))
query("R4", _sql(4), r.CTES)(lambda t: _flat(rules.r4_chain_director(t.position, t.entity, t.company)))
query("R5", _sql(5), r.CTES)(lambda t: _flat(rules.r5_key_person(t.position, t.holding, t.entity, t.company)))
query("R7", _sql(7), r.CTES)(lambda t: _flat(rules.r7_event(t.guarantee_pair)))
query("R7_one_direction", _sql(7).replace("FROM c7", "FROM c7 JOIN guarantee_pair g ON g.id=k1 AND c7.subject_code=g.subject_code").replace(
    "SELECT subject_code", "SELECT c7.subject_code"), r.CTES)(lambda t: _flat(rules.r7_event(t.guarantee_pair, one_direction=True)))


def _chains(df):
    """Products as whole millionths of a percent, so both engines print the same digits."""
    return df.select("target_code", "entity_id", F.floor(F.col("prod") * 1000000 + 0.5).cast("bigint").alias("prod_micro"), "hops",
                     F.array_join(F.col("edge_ids").cast("array<string>"), ">").alias("edge_ids"))


_CHAIN = "SELECT target target_code, holder entity_id, CAST(floor(prod*1000000+0.5) AS BIGINT) prod_micro, hops, array_to_string(ids,'>') edge_ids FROM {} WHERE hops>=2"
query("R6", _CHAIN.format("chain"), r.CTES)(lambda t: _chains(rules.ownership_chains(t.holding, t.entity, t.company)))
query("R6_edge_max", _CHAIN.format("ch"), """eh AS (SELECT entity_id, stock_code, max(ratio) ratio, arg_max(id, (ratio, id)) id FROM holding WHERE ratio IS NOT NULL GROUP BY ALL),"""
      + r.chain("ch", "eh", 1))(lambda t: _chains(rules.ownership_chains(t.holding, t.entity, t.company, min_ratio=1.0, by_edge_max=True)))


@query("W13", """SELECT target target_code, holder entity_id, array_to_string(ids,'>') edge_ids FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY prod DESC, ids) rn
  FROM chain WHERE hops>=2) WHERE rn<=50""", r.CTES)
def w13(t):
    """The report variant of R6: the 50 strongest chains per subject."""
    capped = rules.r6_penetrate(t.holding, t.entity, t.company, limit=50)
    return capped.select(F.col("subject_code").alias("target_code"),
                         F.expr("cast(substring(party_id, 3) as bigint)").alias("entity_id"), F.col("k3").alias("edge_ids"))


_FOLDED = "SELECT subject_code, party_id, party_name, rule_id, confidence, score_c, n_candidates, path FROM parties"
_FOLDED_COLS = ["subject_code", "party_id", "party_name", "rule_id", "confidence", "score_c", "n_candidates", "path"]
query("RE", _FOLDED, r.CTES)(lambda t: folding.readable(t.parties).select(*_FOLDED_COLS))
query("RM", _FOLDED, r.CTES)(lambda t: folding.readable(t.parties).select(*_FOLDED_COLS))
query("RM_as_of", f"""SELECT subject_code, party_id, rule_id, score_c, n_candidates FROM {r.fold("SELECT * FROM cand2")}""",
      r.CTES + """,
cand2 AS (SELECT * FROM c1 UNION ALL SELECT * FROM c3 UNION ALL SELECT * FROM c6 UNION ALL SELECT * FROM c7 UNION ALL
  SELECT c2.* FROM c2 UNION ALL
  SELECT c4.* FROM c4 JOIN position a ON a.id=k1 AND a.stock_code=subject_code JOIN position b ON b.id=k2 AND 'C:'||b.stock_code=party_id
   AND a.entity_id=b.entity_id WHERE a.valid_from<='1997-06-30' AND b.valid_from<='1997-06-30' UNION ALL
  SELECT c5.* FROM c5 JOIN position a ON a.id=k1 AND a.stock_code=subject_code WHERE a.valid_from<='1997-06-30')""")(
    lambda t: folding.fold(rules.all_candidates(t.company, t.entity, t.holding, t.position, t.controller, t.guarantee_pair,
                                                as_of="1997-06-30")).select("subject_code", "party_id", "rule_id", "score_c", "n_candidates"))


@query("RS", """SELECT rule_id, count(*) hits, count(*) FILTER (WHERE confidence='high') high, count(*) FILTER (WHERE confidence='medium') medium, count(*) FILTER (WHERE confidence='low') low
  FROM (SELECT unnest(string_split(rule_id,'+')) rule_id, confidence FROM parties) GROUP BY 1""", r.CTES)
def rs(t):
    return folding.rule_statistics(t.found).select(
        "rule_id", "hits", "high", "medium", "low")


@query("RS_mean", """SELECT count(*) n_companies, CAST(sum(n) AS BIGINT) n_candidates, CAST(sum(high) AS BIGINT) high, CAST(sum(medium) AS BIGINT) medium,
  CAST(sum(low) AS BIGINT) low, CAST(sum(n)*1000//count(*) AS BIGINT) mean_per_company_milli FROM (SELECT subject_code, count(*) n,
  count(*) FILTER (WHERE confidence='high') high, count(*) FILTER (WHERE confidence='medium') medium, count(*) FILTER (WHERE confidence='low') low FROM parties GROUP BY 1)""", r.CTES)
def rs_mean(t):
    return folding.candidate_statistics(t.found)


@query("RM_evidence", """SELECT subject_code, party_id, string_agg(CAST(k AS VARCHAR), ',' ORDER BY rn) pks FROM (SELECT *, row_number() OVER
  (PARTITION BY subject_code, party_id ORDER BY rule_no, -conf, k1, k2, k3, part) rn FROM (
   SELECT subject_code, party_id, rule_no, conf, k1, k2, k3, 0 part, CASE WHEN rule_no=6 THEN 0 ELSE k1 END k FROM cand UNION ALL
   SELECT subject_code, party_id, rule_no, conf, k1, k2, k3, 1, k2 FROM cand WHERE rule_no IN (2,3,4,5))) WHERE rn<=3 GROUP BY 1,2""", r.CTES)
def rm_evidence(t):
    """First three pieces of evidence of each pair."""
    return folding.leading_evidence(t.candidates, 3).select(
        "subject_code", "party_id", F.array_join(F.transform("evidence", lambda e: e["pk"].cast("string")), ",").alias("pks"))
