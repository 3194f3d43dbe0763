"""Parameterised queries, comparison and dossiers."""
import uuid

from pyspark.sql import functions as F

from kinweave import settings as S
from kinweave.catalog import rulesql as r
from kinweave.catalog import sqlkit as q
from kinweave.catalog.evaluation_queries import SG, _gold, aligned
from kinweave.catalog.network_queries import WALKS, _E, _links
from kinweave.catalog.registry import query
from kinweave.catalog.summary_queries import PAIRS_SQL, next_pairs
from kinweave.functions.paths import HOP_TYPE
from kinweave.operators import folding, summaries
from kinweave.plans import evaluation as ev
from kinweave.plans import lookups as k
from kinweave.session import shared_dir

query("Q1", "SELECT subject_code, party_name AS name, rule_id AS rule, confidence, path, score_c/100.0::DOUBLE score FROM parties WHERE confidence IN ('high','medium') AND subject_code IN (SELECT stock_code FROM company)", r.CTES)(
    lambda t: k.related_parties(t.parties, t.company, min_confidence="medium"))
query("Q1_rules", "SELECT subject_code, party_name AS name, rule_id AS rule FROM parties WHERE rule_id IN ('R1','R4+R5')", r.CTES)(
    lambda t: k.related_parties(t.found, rule_ids=["R1", "R4+R5"]).select("subject_code", "name", "rule"))


def _named_pairs(t):
    p = next_pairs(t)
    n = t.company.select("stock_code", "short_name")
    return p.join(n.toDF("a", "a_name"), "a").join(n.toDF("b", "b_name"), "b")


_HITS = """np AS (SELECT a, b, x.short_name a_name, y.short_name b_name FROM pairs JOIN company x ON x.stock_code=a JOIN company y ON y.stock_code=b),
hits AS (SELECT a, b, 1 o, rule_id, confidence, path, party_id FROM np JOIN parties p ON p.subject_code=a AND (party_id='C:'||b OR party_name=b_name OR contains(party_name,b_name))
 UNION ALL SELECT a, b, 2, rule_id, confidence, path, party_id FROM np JOIN parties p ON p.subject_code=b AND (party_id='C:'||a OR party_name=a_name OR contains(party_name,a_name)))"""
_WANTED = "wanted AS MATERIALIZED (SELECT 'C:'||a a, 'C:'||b b FROM np)"
query("Q2", """SELECT a, b, rule_id AS rule, confidence, coalesce(p.path, array_to_string(w.path, ' -> '), '') path, CAST(rule_id IS NOT NULL OR w.path IS NOT NULL AS INTEGER) related
  FROM np LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a,b ORDER BY o, party_id) rn FROM hits) WHERE rn=1) p USING (a,b)
  LEFT JOIN (SELECT substr(a,3) wa, substr(b,3) wb, path FROM walks) w ON rule_id IS NULL AND wa=a AND wb=b""",
      r.CTES + ", " + PAIRS_SQL + ", " + _HITS + ",\n" + _E + ",\n" + _WANTED + ",\n" + WALKS)(
    lambda t: k.relation_of_pairs(t.parties, _named_pairs(t), _links(t), 4))


@query("Q2_walk", """SELECT a, b, CAST(path IS NOT NULL AS INTEGER) related, coalesce(array_to_string(path, ' -> '), '') path FROM np LEFT JOIN
  (SELECT substr(a,3) wa, substr(b,3) wb, path FROM walks) ON wa=a AND wb=b""",
       PAIRS_SQL + ", " + _HITS.split(",\nhits")[0] + ",\n" + _E + ",\n" + _WANTED + ",\n" + WALKS)
def q2_walk(t):
    """The walk alone, for all pairs, as if no rule were known."""
    nobody = t.spark.createDataFrame([], f"subject_code string, party_id string, party_name string, rule_id string, confidence string, path array<{HOP_TYPE}>")
    return k.relation_of_pairs(nobody, _named_pairs(t), _links(t), 4).select("a", "b", "related", "path")


query("Q3", """SELECT entity_id, x.stock_code, relation, ratio, title, short_name FROM (SELECT entity_id, stock_code, 'control' relation, control_ratio ratio, CAST(NULL AS VARCHAR) title
   FROM controller WHERE entity_id IN (SELECT entity_id FROM entity WHERE is_channel=0) UNION ALL SELECT entity_id, stock_code, 'hold', max(ratio), NULL FROM holding GROUP BY 1,2
   UNION ALL SELECT entity_id, stock_code, 'serve', NULL, title FROM position) x JOIN company USING (stock_code)""")(
    lambda t: k.reverse_relations(t.entity, t.company, t.controller, t.holding, t.position))
query("Q3_hold", """SELECT entity_id, stock_code, ratio FROM (SELECT entity_id, stock_code, max(ratio) ratio FROM holding GROUP BY 1,2) JOIN company USING (stock_code) WHERE ratio>=20""")(
    lambda t: k.reverse_relations(t.entity, t.company, t.controller, t.holding, t.position, "hold", 20.0).select("entity_id", "stock_code", "ratio"))
_ROLES = """SELECT stock_code, 'holder' AS role, display_name, entity_type, is_channel, ratio, CAST(NULL AS VARCHAR) title, rk AS "at" FROM (SELECT *, row_number() OVER
   (PARTITION BY stock_code ORDER BY first_id, display_name, entity_type) rk FROM (SELECT stock_code, display_name, entity_type, is_channel, max(ratio) ratio, min(id) first_id
    FROM holding JOIN entity USING (entity_id) GROUP BY 1,2,3,4)) WHERE rk<=10
  UNION ALL SELECT stock_code, 'controller', display_name, entity_type, 0, control_ratio, NULL, id FROM controller JOIN entity USING (entity_id) WHERE is_channel=0
  UNION ALL SELECT stock_code, 'director', display_name, NULL, NULL, NULL, title, id FROM position JOIN entity USING (entity_id)"""
query("Q4", _ROLES)(lambda t: k.company_roles(t.entity, t.holding, t.controller, t.position))
query("Q5", """SELECT event_id, subject_code, event_type, event_date, amount, row_number() OVER (PARTITION BY subject_code ORDER BY event_date, event_id) position FROM event
  WHERE event_type IN ('lawsuit','pledge') AND event_date BETWEEN '2024-01-01' AND '2024-02-10'""")(
    lambda t: k.risk_events(t.event, ["lawsuit", "pledge"], ("2024-01-01", "2024-02-10")).select(
        "event_id", "subject_code", "event_type", "event_date", "amount", "position"))
_OV = """fp AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject_code, party_name ORDER BY party_id) rn FROM parties) WHERE rn=1),
ov AS MATERIALIZED (SELECT a, b, x.party_name AS name, x.rule_id rule_a, y.rule_id rule_b, x.confidence, x.path FROM pairs JOIN fp x ON x.subject_code=a JOIN fp y ON y.subject_code=b AND x.party_name=y.party_name)"""
query("Q6", "SELECT * FROM ov", r.CTES + ", " + PAIRS_SQL + ", " + _OV)(lambda t: k.overlap(t.parties, next_pairs(t)))
query("Q7_industry", """SELECT subject_code, party_id, party_name, rule_id, industry FROM parties JOIN company ON party_id='C:'||stock_code WHERE industry='NATION_7'""", r.CTES)(
    lambda t: k.parties_in_industry(t.found, t.company, "NATION_7"))
query("Q7_largest", """SELECT entity_id, stock_code, ratio, display_name FROM (SELECT entity_id, stock_code, max(ratio) ratio FROM holding WHERE ratio IS NOT NULL GROUP BY 1,2 ORDER BY ratio DESC, 1, 2 LIMIT 10)
  JOIN entity USING (entity_id)""")(lambda t: k.largest_holders(t.holding, t.entity))
query("Q7_controllers", "SELECT entity_id, count(DISTINCT stock_code) n_companies FROM controller GROUP BY 1 HAVING count(DISTINCT stock_code)>=5")(
    lambda t: summaries.controllers_by_companies(t.controller, t.entity).where("n_companies >= 5").select("entity_id", "n_companies"))
_FLAT = f"""roles AS ({_ROLES}),
fl AS (SELECT stock_code, 'basic' block, 'short_name' item, short_name v FROM company UNION ALL SELECT stock_code, 'basic', 'industry', industry FROM company
 UNION ALL SELECT stock_code, 'basic', 'is_st', CAST(is_st AS VARCHAR) FROM company
 UNION ALL SELECT stock_code, 'holders', lpad(CAST("at" AS VARCHAR),2,'0'), display_name||coalesce(' '||CAST(ratio AS VARCHAR)||'%','') FROM roles WHERE role='holder'
 UNION ALL SELECT stock_code, 'controllers', display_name, CAST(ratio AS VARCHAR) FROM roles WHERE role='controller'
 UNION ALL SELECT subject_code, 'related', 'n', CAST(count(*) AS VARCHAR) FROM parties GROUP BY 1
 UNION ALL SELECT stock_code, 'directors', 'n', CAST(count(*) AS VARCHAR) FROM position GROUP BY 1
 UNION ALL SELECT subject_code, 'events', event_type, CAST(count(*) AS VARCHAR)||'|'||CAST(CAST(sum(CAST(coalesce(amount,0) AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS VARCHAR) FROM event GROUP BY 1,3),
 sa AS MATERIALIZED (SELECT a, b, block, item, v FROM pairs JOIN fl ON stock_code=a), sb AS MATERIALIZED (SELECT a, b, block, item, v FROM pairs JOIN fl ON stock_code=b)"""
query("Q8", """SELECT a, b, block, item, sa.v value_a, sb.v value_b FROM sa FULL JOIN sb USING (a,b,block,item)
  UNION ALL SELECT a, b, 'related', 'n_overlap', CAST(count(*) AS VARCHAR), CAST(count(*) AS VARCHAR) FROM ov GROUP BY 1,2
  UNION ALL SELECT a, b, 'directors', 'cross_count', CAST(count(*) AS VARCHAR), CAST(count(*) AS VARCHAR) FROM (SELECT DISTINCT a, b, e1.display_name FROM pairs JOIN position x ON x.stock_code=a
   JOIN entity e1 ON e1.entity_id=x.entity_id JOIN position y ON y.stock_code=b JOIN entity e2 ON e2.entity_id=y.entity_id AND e1.display_name=e2.display_name) GROUP BY 1,2""",
      r.CTES + ", " + PAIRS_SQL + ", " + _OV + ", " + _FLAT)(
    lambda t: k.comparison(next_pairs(t), t.company, t.entity, t.holding, t.controller, t.position, t.event, t.found,
                           ev.shared_names(t.outside, t.members, next_pairs(t))))
query("Q10", f"""SELECT stock_code, display_name, entity_type, CAST(rk AS INTEGER) holder_rank, (SELECT max(h.ratio) FROM holding h JOIN entity e USING (entity_id) WHERE h.stock_code=x.stock_code AND e.display_name=x.display_name) ratio
  FROM (SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY f, display_name) rk FROM (SELECT stock_code, display_name, entity_type, min(id) f FROM holding JOIN entity USING (entity_id)
   WHERE is_channel=0 AND source='{S.BATCH_SOURCE}' GROUP BY 1,2,3)) x WHERE rk<=10""")(lambda t: k.fact_sheet(t.company, t.holding, t.entity))
query("Q11", """SELECT a, b, CAST(EXISTS (SELECT 1 FROM controller x JOIN controller y USING (entity_id) WHERE x.stock_code=a AND y.stock_code=b) OR EXISTS (SELECT 1 FROM holding x JOIN holding y USING (entity_id)
   JOIN entity USING (entity_id) WHERE is_channel=0 AND x.stock_code=a AND y.stock_code=b) AS INTEGER) related FROM pairs""", PAIRS_SQL)(
    lambda t: k.pair_related(next_pairs(t), t.controller, t.holding, t.entity))
query("Q12", "SELECT stock_code, short_name FROM company WHERE stock_code IN (SELECT stock_code FROM controller) ORDER BY md5('42:'||stock_code), stock_code LIMIT 1")(lambda t: k.random_company(t.company, t.controller))
query("Q15", "SELECT stock_code, short_name FROM company WHERE stock_code IN (SELECT lpad(CAST(user_id AS VARCHAR),6,'0') FROM events)")(
    lambda t: k.company_by_code(t.company, t.raw("events").select(F.col("user_id").cast("string").alias("code"))).select("stock_code", "short_name"))


def _dossiers(t):
    return t.once("dossiers", lambda: k.dossiers(
        t.company, t.entity, t.holding, t.controller, t.parties, ev.align(t.parties, _gold(t)), t.event, folding.leading_evidence(t.candidates, 2)))


_ALIGNED = r.CTES + ",\n" + SG + ", " + aligned("al", "parties")
query("Q9", """SELECT c.stock_code, short_name, coalesce(n_matched,0) n_matched, coalesce(n_gold_only,0) n_gold_only, coalesce(n_events,0) n_events, h.names holders FROM company c
  LEFT JOIN (SELECT stock_code, count(*) FILTER (WHERE side='matched') n_matched, count(*) FILTER (WHERE side='gold_only') n_gold_only FROM al GROUP BY 1) USING (stock_code)
  LEFT JOIN (SELECT subject_code stock_code, count(*) n_events FROM event GROUP BY 1) USING (stock_code)
  LEFT JOIN (SELECT stock_code, string_agg(display_name, '|' ORDER BY o, entity_id) names FROM (SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY o, entity_id) rk FROM
   (SELECT stock_code, entity_id, display_name, min(id) o FROM holding JOIN entity USING (entity_id) GROUP BY 1,2,3)) WHERE rk<=10 GROUP BY 1) h USING (stock_code)""", _ALIGNED)(
    lambda t: k.dossier_heads(t.company, t.entity, t.holding, t.event, ev.disclosed_counts(
        t.outside, t.members, _gold(t))).select("stock_code", "short_name", "n_matched", "n_gold_only", "n_events",
                                                                                F.array_join(F.transform("holders", lambda x: x["display_name"]), "|").alias("holders")))
query("Q13_roles", f"""SELECT stock_code, CASE role WHEN 'holder' THEN 0 WHEN 'controller' THEN 1 ELSE 2 END AS block, "at", CASE role
   WHEN 'holder' THEN concat_ws('; ', '#'||CAST("at" AS VARCHAR)||' '||display_name, coalesce(CAST(ratio AS VARCHAR)||'%','?'), entity_type, CASE WHEN is_channel=1 THEN 'channel' END)
   WHEN 'controller' THEN concat_ws('; ', display_name, coalesce(CAST(ratio AS VARCHAR)||'%','?')) ELSE concat_ws('; ', display_name, title) END line FROM ({_ROLES})""")(
    lambda t: k.role_lines(k.company_roles(t.entity, t.holding, t.controller, t.position)))
query("SNK5_items", """SELECT stock_code, section, count(*) n FROM (SELECT stock_code, 'controllers' AS section FROM controller JOIN entity USING (entity_id) WHERE is_channel=0 UNION ALL SELECT stock_code, 'disclosed' FROM al WHERE side<>'system_only'
  UNION ALL SELECT subject_code, 'found' FROM parties UNION ALL SELECT subject_code, 'events' FROM event) GROUP BY 1,2""", _ALIGNED)(
    lambda t: k.dossier_items(t.entity, t.controller, t.found, ev.disclosed_names(t.outside, t.members, _gold(t)).withColumn(
        "side", F.when(F.col("hit"), "matched").otherwise("gold_only")), t.event).groupBy("stock_code", "section").agg(F.count("*").alias("n")))
_LABEL = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in S.EVENT_LABELS.items()) + " ELSE event_type END"
query("Q13_events", f"""SELECT subject_code stock_code, string_agg(block, chr(10) ORDER BY d, e) AS text FROM (
  SELECT subject_code, '['||{_LABEL}||'] '||CAST(max(n) AS VARCHAR)||'; '||CAST(max(amt) AS VARCHAR)||chr(10)||string_agg(line, chr(10) ORDER BY rk) block,
   arg_min(event_date, rk) d, arg_min(event_id, rk) e FROM (SELECT subject_code, event_type, event_date, event_id,
    concat_ws('; ', coalesce(event_date,'?'), left(coalesce(summary,''),60), counterparty) line,
    row_number() OVER (PARTITION BY subject_code, event_type ORDER BY event_date, event_id) rk, count(*) OVER (PARTITION BY subject_code, event_type) n,
    CAST(sum(CAST(coalesce(amount,0) AS DECIMAL(18,2))) OVER (PARTITION BY subject_code, event_type) AS DECIMAL(28,2)) amt FROM event) WHERE rk<=5
   GROUP BY subject_code, event_type) GROUP BY 1""")(lambda t: k.event_text(t.event))
def _block(rows, order, line):
    """Per company the number of rows and the lines of the first ten."""
    return f"""(SELECT stock_code, count(*) n, string_agg(line, chr(10) ORDER BY rk) FILTER (WHERE rk<=10) t FROM (
  SELECT stock_code, {line} line, row_number() OVER (PARTITION BY stock_code ORDER BY {order}) rk FROM ({rows})) GROUP BY 1)"""


_HOLDERS = f"""SELECT h.stock_code, display_name, coalesce(max(ratio), any_value(kr)) ratio, entity_type, min(id) o, h.entity_id FROM holding h JOIN entity USING (entity_id)
  LEFT JOIN (SELECT stock_code, display_name, max(ratio) kr FROM holding JOIN entity USING (entity_id) WHERE source='{S.CHANGE_SOURCE}' GROUP BY 1,2) USING (stock_code, display_name)
  GROUP BY h.stock_code, h.entity_id, display_name, entity_type"""
_HOLDERS = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY o, entity_id) r FROM ({_HOLDERS})) WHERE r<=10"
_NEW = f"""SELECT p.* FROM (SELECT *, subject_code stock_code, {q.aligned('party_name')} AS name FROM parties) p
  ANTI JOIN (SELECT stock_code, name FROM al WHERE side='matched') USING (stock_code, name)"""
_BLOCKS = {
    "holders": _block(_HOLDERS, "o, entity_id", "concat_ws('; ', display_name, coalesce(CAST(ratio AS VARCHAR),'?'), entity_type)"),
    "controllers": _block("SELECT * FROM controller JOIN entity USING (entity_id) WHERE is_channel=0", "id", "concat_ws('; ', display_name, coalesce(CAST(control_ratio AS VARCHAR),'?'))"),
    "disclosed and found": _block("SELECT * FROM al WHERE side='matched'", "name", "name"),
    "found only": _block(_NEW, "score_c DESC, party_id", "concat_ws('; ', party_name, rule_id, confidence, path)"),
    "disclosed only": _block("SELECT * FROM al WHERE side='gold_only'", "name", "name"),
    "events": _block("SELECT *, subject_code stock_code FROM event", "event_date, event_id",
                     "concat_ws('; ', coalesce(event_date,'?'), event_type, coalesce(CAST(CAST(amount AS DECIMAL(18,2)) AS VARCHAR),'?'), summary)"),
}
query("Q14", "SELECT c.stock_code, concat_ws(chr(10), concat_ws('; ', c.stock_code, short_name, coalesce(industry,'?')), "
      + ", ".join(f"'[{name}] '||CAST(coalesce(b{i}.n,0) AS VARCHAR), b{i}.t" for i, name in enumerate(_BLOCKS))
      + "".join(f", '{k_}: {v}'" for k_, v in S.DOSSIER_NOTES.items()) + ") AS text FROM company c"
      + "".join(f" LEFT JOIN {sql} b{i} ON b{i}.stock_code=c.stock_code" for i, sql in enumerate(_BLOCKS.values())), _ALIGNED)(
    lambda t: k.dossier_text(_dossiers(t)))
_COUNTS = dict(zip(("n_holders", "n_controllers", "n_matched", "n_system_only", "n_gold_only", "n_events"), _BLOCKS.values()))


@query("SNK5", "SELECT c.stock_code, short_name, " + ", ".join(f"coalesce({n}.n,0) {n}" for n in _COUNTS) + ", best, first_event FROM company c"
       + "".join(f" LEFT JOIN {sql} {n} ON {n}.stock_code=c.stock_code" for n, sql in _COUNTS.items())
       + f""" LEFT JOIN (SELECT stock_code, party_name best FROM (SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY score_c DESC, party_id) rk FROM ({_NEW})) WHERE rk=1) b
   ON b.stock_code=c.stock_code LEFT JOIN (SELECT subject_code, arg_min(event_date, (event_date, event_id)) first_event FROM event GROUP BY 1) f ON f.subject_code=c.stock_code""", _ALIGNED)
def snk5(t):
    """Dossiers written as JSON lines and read back."""
    rows = _dossiers(t)
    path = f"{shared_dir(t.spark)}/kinweave/{t.spark.sparkContext.applicationId}/dossiers-{uuid.uuid4().hex[:8]}"
    k.write_dossiers(rows, path)
    d = t.spark.read.schema("stock_code string, dossier string").json(path).select(F.from_json("dossier", rows.schema).alias("d"))
    size = lambda c, n: F.coalesce(F.size(f"d.{c}"), F.lit(0)).cast("bigint").alias(n)
    return d.select("d.stock_code", "d.short_name", size("holders", "n_holders"), size("controllers", "n_controllers"), size("matched", "n_matched"),
                    size("system_only", "n_system_only"), size("gold_only", "n_gold_only"), size("events", "n_events"),
                    F.get("d.system_only", F.lit(0))["name"].alias("best"), F.get("d.events", F.lit(0))["event_date"].alias("first_event"))
