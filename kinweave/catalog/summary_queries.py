"""Filters, joins, aggregations, rankings and set operations."""
from pyspark.sql import functions as F

from kinweave import settings as S
from kinweave.catalog import rulesql as r
from kinweave.catalog.registry import query
from kinweave.functions import codes
from kinweave.operators import found, summaries as s
from kinweave.operators.skew import spread_join
from kinweave.plans import evaluation as ev

_SENIOR = "('director','supervisor','senior_mgmt')"

# ---- filters ----
query("F1", "SELECT id FROM holding WHERE (valid_from IS NULL OR valid_from='' OR valid_from<='1997-06-30') AND (valid_to IS NULL OR valid_to='' OR valid_to>='1997-06-30')")(
    lambda t: t.holding.where(codes.valid_at("valid_from", "valid_to", "1997-06-30")).select("id"))
query("F2", "SELECT id FROM holding WHERE entity_id IN (SELECT entity_id FROM entity WHERE is_channel=0)")(
    lambda t: t.holding.join(t.entity.where("is_channel = 0").select("entity_id"), "entity_id", "left_semi").select("id"))
query("F3", f"SELECT id, stock_code FROM position WHERE title_class IN {_SENIOR}")(
    lambda t: t.position.where(F.col("title_class").isin(S.RULES["R4"]["title_classes"])).select("id", "stock_code"))
query("F4", "SELECT event_id FROM event WHERE event_type IN ('guarantee','lawsuit') AND event_date BETWEEN '2024-01-05' AND '2024-01-20'")(
    lambda t: t.event.where(F.col("event_type").isin("guarantee", "lawsuit") & F.col("event_date").between("2024-01-05", "2024-01-20")).select("event_id"))
query("F5", "SELECT subject_code, party_id FROM parties WHERE confidence IN ('high','medium') AND rule_id IN ('R1','R2','R4+R5')", r.CTES)(
    lambda t: t.found.where((codes.confidence_rank("confidence") >= 2) & F.col("rule_id").isin("R1", "R2", "R4+R5")).select("subject_code", "party_id"))
query("F6", "SELECT entity_id FROM entity WHERE contains(display_name,'0001') OR lower(canonical_name)=lower('CUSTOMER#000000007')")(
    lambda t: t.entity.where(F.col("display_name").contains("0001") | (F.lower("canonical_name") == "customer#000000007")).select("entity_id"))

# ---- joins ----
query("J1", "SELECT h.id, display_name, coalesce(short_name, h.stock_code) short_name FROM holding h JOIN entity USING (entity_id) LEFT JOIN company USING (stock_code)")(
    lambda t: s.named_facts(t.holding, t.entity, t.company).select("id", "display_name", "short_name"))


@query("J2", "SELECT a.id, a.stock_code, b.id o_id, b.stock_code o_code FROM position a JOIN position b ON a.entity_id=b.entity_id AND a.stock_code<>b.stock_code")
def j2(t):
    other = t.position.select("entity_id", F.col("id").alias("o_id"), F.col("stock_code").alias("o_code"))
    return spread_join(t.position.select("entity_id", "id", "stock_code"), other, ["entity_id"], ["id"]).where(
        "stock_code <> o_code").drop("entity_id")


query("J3", "SELECT id FROM controller WHERE entity_id IN (SELECT entity_id FROM entity WHERE is_channel=0)")(
    lambda t: t.controller.join(t.entity.where("is_channel = 0").select("entity_id"), "entity_id", "left_semi").select("id"))
query("J4", "SELECT stock_code FROM company WHERE stock_code NOT IN (SELECT stock_code FROM position WHERE valid_from>='2001-06-01')")(
    lambda t: t.company.join(t.position.where("valid_from >= '2001-06-01'").select("stock_code"), "stock_code", "left_anti").select("stock_code"))
query("J5", "SELECT entity_id, display_name, min(stock_code) listed_code FROM entity JOIN company ON display_name=short_name GROUP BY 1,2")(
    lambda t: s.entity_to_company(t.entity, t.company))
query("J6", "SELECT h.id, m.ratio FROM named h LEFT JOIN best m USING (stock_code, display_name)",
      """named AS MATERIALIZED (SELECT id, stock_code, display_name, ratio FROM holding JOIN entity USING (entity_id)),
best AS MATERIALIZED (SELECT stock_code, display_name, max(ratio) ratio FROM named GROUP BY 1,2)""")(
    lambda t: t.holding.drop("ratio").join(t.entity.select("entity_id", "display_name"), "entity_id").join(
        s.ratio_by_name(t.holding, t.entity), ["stock_code", "display_name"], "left").select("id", "ratio"))
query("J7", """SELECT name, f first_id, id other_id FROM (SELECT name, id, min(id) OVER (PARTITION BY name) f FROM holder_name) WHERE id<>f""")(
    lambda t: s.homonyms(t.holder_name))
_PREFIX = "SELECT DISTINCT left(short_name, CASE WHEN s%3=0 THEN 15 ELSE 18 END) AS name FROM (SELECT short_name, CAST(stock_code AS BIGINT) s FROM company)"
query("J10", f"""SELECT name, entity_id, display_name, hold_count FROM (SELECT n.name, e.entity_id, e.display_name, hold_count, row_number() OVER
  (PARTITION BY n.name ORDER BY hold_count DESC, e.entity_id) rn FROM ({_PREFIX}) n JOIN entity e ON starts_with(e.display_name, n.name) AND is_channel=0
  JOIN (SELECT entity_id, count(*) hold_count FROM holding GROUP BY 1) USING (entity_id)) WHERE rn=1""")(
    lambda t: s.prefix_match(t.company.select(F.expr("left(short_name, CASE WHEN cast(stock_code as bigint) % 3 = 0 THEN 15 ELSE 18 END)").alias(
        "name")).distinct(), t.entity, t.holding))

# ---- aggregations ----
query("A1", """SELECT stock_code, entity_id, max(ratio) ratio, max(id) id, max(holder_rank) holder_rank, max(report_period) report_period, max(source) source,
  entity_type, confidence FROM holding JOIN entity USING (entity_id) WHERE is_channel=0 GROUP BY stock_code, entity_id, entity_type, confidence""".replace(
      "entity_type, confidence FROM", "entity_type, confidence FROM"))(lambda t: s.holder_maxima(t.holding, t.entity))
_BY_NAME = "SELECT stock_code, display_name, entity_type, is_channel, max(ratio) ratio, min(id) first_id FROM holding JOIN entity USING (entity_id) GROUP BY 1,2,3,4"
query("A2", _BY_NAME)(lambda t: s.holders_by_name(t.holding, t.entity))
_RECORDS = "SELECT entity_id, canonical_name, display_name, CAST(count(*) AS BIGINT) n_records FROM (SELECT entity_id FROM position UNION ALL SELECT entity_id FROM holding) JOIN entity USING (entity_id) WHERE entity_type='person' AND is_channel=0 GROUP BY 1,2,3"
query("A3", f"SELECT * FROM ({_RECORDS}) WHERE n_records>20")(lambda t: s.person_records(t.position, t.holding, t.entity).where("n_records > 20"))
query("A4", "SELECT entity_id, count(DISTINCT stock_code) n_companies FROM (SELECT entity_id, stock_code FROM position UNION ALL SELECT entity_id, stock_code FROM holding) GROUP BY 1")(
    lambda t: s.company_counts(t.position, t.holding))
query("A5", "SELECT subject_code, event_type, count(*) n, CAST(sum(CAST(coalesce(amount,0) AS DECIMAL(18,2))) AS DECIMAL(28,2)) total_amount FROM event GROUP BY 1,2")(
    lambda t: s.event_totals(t.event, ("subject_code", "event_type")))
query("A6", "SELECT event_type, source_type, count(*) n, count(DISTINCT subject_code) n_companies FROM event GROUP BY GROUPING SETS ((event_type, source_type), (event_type), ())")(
    lambda t: s.event_sources(t.event))
query("A9", "SELECT entity_id, count(DISTINCT stock_code) n_companies, display_name FROM controller JOIN entity USING (entity_id) GROUP BY entity_id, display_name ORDER BY n_companies DESC, entity_id LIMIT 50")(
    lambda t: s.top(s.controllers_by_companies(t.controller, t.entity), 50, F.desc("n_companies"), "entity_id"))
query("A10", "SELECT 'actual_controller' table_name, count(DISTINCT stock_code) n_companies FROM controller UNION ALL SELECT 'holding', count(DISTINCT stock_code) FROM holding UNION ALL SELECT 'position', count(DISTINCT stock_code) FROM position")(
    lambda t: s.companies_per_table(actual_controller=t.controller, holding=t.holding, position=t.position))
query("A11", "SELECT entity_id, count(DISTINCT stock_code) n_companies, display_name FROM controller JOIN entity USING (entity_id) GROUP BY entity_id, display_name HAVING count(DISTINCT stock_code)>=5")(
    lambda t: s.controllers_by_companies(t.controller, t.entity).where("n_companies >= 5"))
query("A12", """SELECT 'n_companies' figure, count(*) AS value FROM company UNION ALL SELECT 'holding_companies', count(DISTINCT stock_code) FROM holding
  UNION ALL SELECT 'non_channel_rows', count(*) FILTER (WHERE is_channel=0) FROM holding JOIN entity USING (entity_id)
  UNION ALL SELECT 'channel_share_bp', CAST(sum(is_channel)*10000//count(*) AS BIGINT) FROM holding JOIN entity USING (entity_id)
  UNION ALL SELECT 'non_channel_per_company_milli', CAST(sum(n)*1000//count(*) AS BIGINT) FROM (SELECT count(*) n FROM holding JOIN entity USING (entity_id) WHERE is_channel=0 GROUP BY stock_code)
  UNION ALL SELECT 'people', count(DISTINCT entity_id) FROM position
  UNION ALL SELECT 'people_in_two_companies', count(*) FROM (SELECT entity_id FROM position GROUP BY 1 HAVING count(DISTINCT stock_code)>=2)
  UNION ALL SELECT 'controlled_companies', count(DISTINCT stock_code) FROM controller""")(
    lambda t: s.coverage(t.company, t.holding, t.entity, t.position, t.controller))
query("A14", """SELECT event_type, n, v[1+least(CAST(floor(n*50/100) AS BIGINT), n-1)] p50, v[1+least(CAST(floor(n*95/100) AS BIGINT), n-1)] p95 FROM
  (SELECT event_type, count(*) n, list(amount ORDER BY amount) v FROM event GROUP BY 1)""")(
    lambda t: s.nearest_rank(t.event, ["event_type"], "amount"))

# ---- rankings ----
_TOP = f"SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY first_id, display_name, entity_type) rank FROM ({_BY_NAME})"
query("W1", f"SELECT stock_code, display_name, ratio FROM ({_TOP}) WHERE rank<=10")(
    lambda t: s.top_holders(t.holding, t.entity).select("stock_code", "display_name", "ratio"))
query("W2", f"SELECT stock_code, display_name, CAST(rank AS INTEGER) rank FROM ({_TOP}) WHERE rank<=10")(
    lambda t: s.top_holders(t.holding, t.entity).select("stock_code", "display_name", "rank"))
query("W3", "SELECT event_id, subject_code, row_number() OVER (PARTITION BY subject_code ORDER BY event_date, event_id) position FROM event")(
    lambda t: s.event_order(t.event).select("event_id", "subject_code", "position"))
query("W8", """SELECT stock_code, CAST(min(p) AS INTEGER) priority FROM (SELECT stock_code, 0 p FROM controller UNION ALL SELECT stock_code, 1 FROM position UNION ALL SELECT stock_code, 2 FROM company)
  GROUP BY 1 ORDER BY 2, 1 LIMIT 300""")(lambda t: s.evaluation_pool(t.company, t.controller, t.position))
query("W7", """SELECT event_id, event_type, event_date, subject_code, counterparty, amount, summary, source_type, ts, CAST(rank AS INTEGER) rank FROM (SELECT *, row_number() OVER
  (PARTITION BY event_type ORDER BY md5('42:'||CAST(event_id AS VARCHAR)), event_id) rank FROM event) WHERE rank<=20""")(lambda t: s.stratified_sample(t.event, "event_type", "event_id", 20))
query("W9", f"""SELECT subject_code, party_id, CAST(CASE split_part(rule_id,'+',1) {' '.join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(S.REVIEW_RULE_ORDER))} ELSE 99 END AS INTEGER) rule_order,
  CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END conf_order, score_c FROM parties""", r.CTES)(
    lambda t: s.review_order_of(found.folded(t.pairs, t.company), t.alone, found.scores_alone()).select("subject_code", "party_id", "rule_order", "conf_order", "score_c"))
query("W12", """SELECT entity_id, stock_code, r ratio, row_number() OVER (PARTITION BY entity_id ORDER BY r DESC NULLS LAST, stock_code) rank FROM
  (SELECT entity_id, stock_code, max(ratio) r FROM holding GROUP BY 1,2)""")(
    lambda t: s.reverse_holdings(t.holding))

# ---- sets ----
query("S1", """SELECT entity_id, 'position' AS "table", id, stock_code, title, valid_from, source FROM position UNION ALL
  SELECT entity_id, 'holding', id, stock_code, '', valid_from, source FROM holding""")(lambda t: s.records(t.position, t.holding).drop("t"))
query("S2", "SELECT entity_id, stock_code FROM position UNION SELECT entity_id, stock_code FROM holding")(
    lambda t: t.position.select("entity_id", "stock_code").union(t.holding.select("entity_id", "stock_code")).distinct())


def next_pairs(t):
    """Every company with the one after it by code."""
    nxt = F.lpad((F.col("stock_code").cast("bigint") + 1).cast("string"), 6, "0")
    return t.company.select(F.col("stock_code").alias("a"), nxt.alias("b"))


PAIRS_SQL = "pairs AS (SELECT stock_code a, lpad(CAST(CAST(stock_code AS BIGINT)+1 AS VARCHAR),6,'0') b FROM company)"
query("S4", """SELECT DISTINCT a, b, x.party_name AS name FROM pairs JOIN parties x ON x.subject_code=a JOIN parties y ON y.subject_code=b AND x.party_name=y.party_name""",
      r.CTES + ", " + PAIRS_SQL)(lambda t: ev.shared_names(t.outside, t.members, next_pairs(t)))
query("S5", """SELECT DISTINCT a, b, e1.display_name AS name FROM pairs JOIN position x ON x.stock_code=a JOIN entity e1 ON e1.entity_id=x.entity_id
  JOIN position y ON y.stock_code=b JOIN entity e2 ON e2.entity_id=y.entity_id AND e1.display_name=e2.display_name""", PAIRS_SQL)(
    lambda t: s.shared_names(t.position.join(t.entity.select("entity_id", "display_name"), "entity_id").select(
        F.col("stock_code").alias("subject_code"), F.col("display_name").alias("party_name")), next_pairs(t)))
