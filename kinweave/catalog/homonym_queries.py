"""Homonym signals, clusters and splits."""
import re

from pyspark.sql import functions as F

from kinweave import settings as S
from kinweave.catalog import rulesql as r
from kinweave.catalog.evaluation_queries import FIG, SG, _gold, aligned, figures
from kinweave.catalog.registry import query
from kinweave.operators import folding, homonyms as h, rules, summaries
from kinweave.plans import evaluation as ev

RECS = """ppl AS (SELECT entity_id, canonical_name, display_name FROM entity WHERE entity_type='person' AND is_channel=0),
recs AS (SELECT r.*, row_number() OVER (PARTITION BY entity_id ORDER BY t, id) pos, row_number() OVER (PARTITION BY entity_id ORDER BY t DESC, id DESC) back,
  count(*) OVER (PARTITION BY entity_id) n_records, canonical_name, display_name FROM
 (SELECT entity_id, 0 t, 'position' tbl, id, stock_code, title, valid_from, source FROM position UNION ALL
  SELECT entity_id, 1, 'holding', id, stock_code, '', valid_from, source FROM holding) r JOIN ppl USING (entity_id)),
reach AS (SELECT entity_id, count(DISTINCT stock_code) n_companies FROM recs GROUP BY 1)"""


def scored(pairs):
    held = f"IN ('{S.CHANGE_SOURCE}','{S.BATCH_SOURCE}')"
    d = "abs(date_diff('day', CAST(a_from AS DATE), CAST(b_from AS DATE)))"
    return f"""(SELECT *, CAST(floor((25*name_rarity+25*holding_cross+20*company_count+5*region_match+25*tenure_overlap+50)/100) AS INTEGER) score_m FROM
 (SELECT *, CAST(CASE WHEN n_companies<=2 THEN 900 WHEN n_companies<=5 THEN 600 WHEN n_companies<=20 THEN 350 ELSE 150 END AS INTEGER) name_rarity,
   CAST(CASE WHEN a_source {held} AND b_source {held} THEN CASE WHEN {d}<=365 THEN 700 ELSE 500 END ELSE 500 END AS INTEGER) holding_cross,
   CAST(CASE WHEN n_companies<=3 THEN 700 WHEN n_companies<=10 THEN 500 ELSE 200 END AS INTEGER) company_count, CAST(500 AS INTEGER) region_match,
   CAST(CASE WHEN {d}<=1095 THEN 650 ELSE 300 END AS INTEGER) tenure_overlap FROM ({pairs})))"""


PAIRS = """SELECT a.entity_id, a.canonical_name, a.display_name, a.n_records, n_companies, a.tbl a_table, a.stock_code a_code, a.title a_title, a.valid_from a_from,
  a.source a_source, b.tbl b_table, b.stock_code b_code, b.title b_title, b.valid_from b_from, b.source b_source
  FROM recs a JOIN recs b ON a.entity_id=b.entity_id AND a.pos=1 AND b.back=1 AND a.n_records>=2 JOIN reach r ON r.entity_id=a.entity_id"""


def _pairs(t):
    return h.first_last_pairs(t.position, t.holding, t.entity)


def _scored(t):
    return h.scored_pairs(_pairs(t))


for _id, _signal in (("D1", "name_rarity"), ("D2", "holding_cross"), ("D3", "company_count"), ("D4", "region_match"),
                     ("D5", "tenure_overlap"), ("D6", "score_m")):
    query(_id, f"SELECT entity_id, {_signal} FROM {scored(PAIRS)}", RECS)(lambda t, c=_signal: _scored(t).select("entity_id", c))
query("D7", f"""SELECT entity_id, CAST(score_m>700 AS INTEGER) same_person, CASE WHEN score_m>700 OR score_m<400 THEN 'high' ELSE 'medium' END pair_confidence
  FROM {scored(PAIRS)}""", RECS)(lambda t: _scored(t).select("entity_id", "same_person", "pair_confidence"))
_HELD = f"IN ('{S.CHANGE_SOURCE}','{S.BATCH_SOURCE}')"
_DAYS = "abs(date_diff('day', CAST({0}.valid_from AS DATE), CAST({1}.valid_from AS DATE)))"


def _score(a, b):
    """Score in thousandths of two records with the number of companies of b's person."""
    days = _DAYS.format(a, b)
    return f"""CAST(floor((25*CASE WHEN {b}.n_companies<=2 THEN 900 WHEN {b}.n_companies<=5 THEN 600 WHEN {b}.n_companies<=20 THEN 350 ELSE 150 END
 +25*CASE WHEN {a}.source {_HELD} AND {b}.source {_HELD} THEN CASE WHEN {days}<=365 THEN 700 ELSE 500 END ELSE 500 END
 +20*CASE WHEN {b}.n_companies<=3 THEN 700 WHEN {b}.n_companies<=10 THEN 500 ELSE 200 END+5*500
 +25*CASE WHEN {days}<=1095 THEN 650 ELSE 300 END+50)/100) AS INTEGER)"""


#: The plain walk over every record: the first cluster whose first record it matches, else a new one. (WALK goes with WITH RECURSIVE.)
WALK = RECS + f""",
rw AS MATERIALIZED (SELECT entity_id, canonical_name, display_name, tbl, id, pos, struct_pack(id:=id, source:=source, valid_from:=valid_from, n_companies:=n_companies) rec
  FROM recs JOIN reach USING (entity_id) WHERE n_records>={h.MIN_RECORDS}),
walk AS (SELECT entity_id, pos, 0 cl, [rec] reps FROM rw WHERE pos=1 UNION ALL
  SELECT entity_id, pos, CAST(coalesce(nullif(m,0)-1, len(reps)) AS INTEGER), CASE WHEN coalesce(m,0)=0 THEN list_append(reps, rec) ELSE reps END FROM (
   SELECT r.entity_id, r.pos, r.rec, w.reps, list_position(list_transform(w.reps, lambda q: {_score('q', 'r.rec')}>{S.SAME_ABOVE}), true) m
   FROM walk w JOIN rw r ON r.entity_id=w.entity_id AND r.pos=w.pos+1)),
done AS MATERIALIZED (SELECT rw.*, cl, reps FROM walk JOIN rw USING (entity_id, pos))"""
query("D8", f"""SELECT entity_id, tbl AS "table", id, CAST(c-1 AS INTEGER) AS cluster, reps[c].id rep_id, {_score('reps[c]', 'rec')} score_m FROM (
  SELECT *, unnest(range(1, CASE WHEN reps[cl+1].id=id AND reps[cl+1].source=rec.source THEN cl+1 ELSE cl+2 END)) c FROM done)""", WALK, recursive=True)(
    lambda t: h.against_representatives(t.position, t.holding, t.entity).select("entity_id", "table", "id", "cluster", "rep_id", "score_m"))


@query("D9", 'SELECT entity_id, tbl AS "table", id, cl AS cluster FROM done', WALK, recursive=True)
def d9(t):
    """Clusters of every person's records."""
    return h.clusters(t.position, t.holding, t.entity).select("entity_id", "table", "id", "cluster")


def _split(t):
    return h.split(t.entity, t.position, t.holding, t.once("clusters", lambda: h.clusters(t.position, t.holding, t.entity)))


@query("D10", f"""SELECT entity_id, canonical_name, display_name, confidence, disambig_note FROM entity UNION ALL
  SELECT -(entity_id*{h.CLUSTER_IDS}+cl), canonical_name||'#D'||CAST(cl+1 AS VARCHAR), display_name, 'medium',
   'split from E:'||CAST(entity_id AS VARCHAR)||' cluster'||CAST(cl+1 AS VARCHAR)||' (records='||CAST(count(*) AS VARCHAR)||')' FROM done WHERE cl>0
   GROUP BY entity_id, canonical_name, display_name, cl""", WALK, recursive=True)
def d10(t):
    """Entities after the split."""
    return _split(t)[0].select("entity_id", "canonical_name", "display_name", "confidence", "disambig_note")


query("D11", "SELECT entity_id, canonical_name, display_name, n_records FROM recs WHERE pos=1 AND n_records>20 ORDER BY n_records DESC, entity_id LIMIT 10", RECS)(
    lambda t: summaries.top(summaries.person_records(t.position, t.holding, t.entity).where("n_records > 20"), 10,
                            F.desc("n_records"), "entity_id"))


@query("D12", "SELECT id, entity_id FROM holding")
def d12(t):
    """Splitting and undoing gives the facts as they were."""
    e, _, holding = _split(t)
    return h.undo(holding, e).select("id", "entity_id")


query("D13", f"""SELECT count(*) n, count(*) FILTER (WHERE score_m>700) same, count(*) FILTER (WHERE score_m<400) different,
  count(*) FILTER (WHERE score_m BETWEEN 400 AND 700) middle FROM {scored(PAIRS)}""", RECS)(lambda t: h.tier_shares(_scored(t)))


_SPLIT = f"""moved AS MATERIALIZED (SELECT entity_id, tbl, id, canonical_name, display_name, cl, -(entity_id*{h.CLUSTER_IDS}+cl) new_id FROM done WHERE cl>0),
entity_s AS MATERIALIZED (SELECT entity_id, entity_type, canonical_name, display_name, is_channel, confidence FROM entity UNION ALL
  SELECT DISTINCT new_id, 'person', canonical_name||'#D'||CAST(cl+1 AS VARCHAR), display_name, 0, 'medium' FROM moved),
holding_s AS MATERIALIZED (SELECT f.* REPLACE (coalesce(m.new_id, f.entity_id) AS entity_id) FROM holding f LEFT JOIN moved m ON m.tbl='holding' AND m.id=f.id AND m.entity_id=f.entity_id),
position_s AS MATERIALIZED (SELECT f.* REPLACE (coalesce(m.new_id, f.entity_id) AS entity_id) FROM position f LEFT JOIN moved m ON m.tbl='position' AND m.id=f.id AND m.entity_id=f.entity_id)"""
#: The rules over the tables after the split: the same text with other table names.
_RULES_AFTER = re.sub(r"\b(entity|holding|position|c[1-7o]|chain\w*|large|cand|parties)\b", r"\1_s", r.CTES)


@query("D14", figures(f"SELECT 'before' AS state, {FIG} FROM al UNION ALL SELECT 'after', {FIG} FROM al_s", "state, "),
       ",\n".join([WALK, _SPLIT, r.CTES, _RULES_AFTER, SG, aligned("al", "parties", "upstream"), aligned("al_s", "parties_s", "upstream")]), recursive=True)
def d14(t):
    """Figures before and after the split."""
    gold = _gold(t)
    e, p, hd = _split(t)
    after = t.once("runs_after_split", lambda: rules.runs_outside_control(t.company, e, hd, p, t.controller, t.guarantee_pair))

    def one(runs, entity, label):
        members = rules.control_members(t.controller, entity, t.company)
        return ev.figures_under_control(folding.fold_runs(runs), members, gold, "upstream").withColumn("state", F.lit(label))
    return one(t.runs_outside_control, t.entity, "before").unionByName(one(after, e, "after"))


query("W5", f"SELECT entity_id, a_table, a_code, a_from, b_table, b_code, b_from FROM ({PAIRS})", RECS)(
    lambda t: _pairs(t).select("entity_id", "a_table", "a_code", "a_from", "b_table", "b_code", "b_from"))
query("W6", f"""SELECT entity_id, tier, score_m FROM (SELECT *, count(*) FILTER (WHERE rn<=85) OVER () base FROM (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY n_records DESC, entity_id) rn FROM
  (SELECT *, CASE WHEN score_m>750 THEN 'high' WHEN score_m<350 THEN 'low' ELSE 'mid' END tier FROM {scored(PAIRS)})))
  WHERE rn<=85 OR (tier='mid' AND rn<=85+greatest(0,200-base))""", RECS)(
    lambda t: h.annotation_set(_scored(t)).select("entity_id", "tier", "score_m"))
query("EV16", f"""SELECT p.canonical_name, p.a_code, p.b_code, coalesce(ca.short_name,'?') a_name, coalesce(ca.industry,'?') a_industry, coalesce(cb.short_name,'?') b_name,
  coalesce(cb.industry,'?') b_industry, CAST(EXISTS (SELECT 1 FROM holding JOIN entity USING (entity_id) WHERE canonical_name=p.canonical_name AND stock_code=p.a_code) AS INTEGER) a_holds,
  CAST(EXISTS (SELECT 1 FROM holding JOIN entity USING (entity_id) WHERE canonical_name=p.canonical_name AND stock_code=p.b_code) AS INTEGER) b_holds,
  (SELECT count(DISTINCT stock_code) FROM position JOIN entity USING (entity_id) WHERE canonical_name=p.canonical_name) name_companies
  FROM ({PAIRS}) p LEFT JOIN company ca ON ca.stock_code=a_code LEFT JOIN company cb ON cb.stock_code=b_code""", RECS)(
    lambda t: ev.pair_sheet(_pairs(t), t.company, t.entity, t.position, t.holding).select(
        "canonical_name", "a_code", "b_code", "a_name", "a_industry", "b_name", "b_industry", "a_holds", "b_holds", "name_companies"))
