"""Evaluation against disclosed parties, reviews, labels and graded answers."""
from pyspark.sql import functions as F

from kinweave import settings as S
from kinweave.catalog import rulesql as r
from kinweave.catalog import sqlkit as q
from kinweave.catalog.registry import query
from kinweave.operators import summaries
from kinweave.plans import evaluation as ev


def _rx(words):
    return q.lit("(?i)" + "|".join(words))


SCOPE = f"""CASE WHEN relation_desc<>'' THEN CASE WHEN regexp_matches(relation_desc, {_rx(S.DOWNSTREAM_DESC)}) THEN 'downstream'
 WHEN regexp_matches(relation_desc, {_rx(S.UPSTREAM_DESC)}) THEN 'upstream' ELSE 'other' END
 WHEN regexp_matches(party_name, {_rx(S.DOWNSTREAM_NAME)}) THEN 'downstream'
 WHEN length(party_name)<=4 AND party_name<>'' AND NOT {q.any_word('party_name', S.SCOPE_ORG_WORDS)} THEN 'upstream' ELSE 'other' END"""
SG = f"sg AS (SELECT *, {SCOPE} scope_class FROM gold)"


def aligned(name, parties, scope=None, setting=""):
    """CTE with columns (setting,) stock_code, name, side."""
    s = "setting, " if setting else ""
    where = f" AND scope_class='{scope}'" if scope else ""
    known = (f"SELECT DISTINCT {setting}.setting, stock_code, {q.aligned('party_name')} AS name FROM sg, {setting} WHERE true{where}" if setting else
             f"SELECT DISTINCT stock_code, {q.aligned('party_name')} AS name FROM sg WHERE true{where}")
    return f"""{name} AS (SELECT {s}stock_code, name, CASE WHEN max(f)=0 THEN 'gold_only' WHEN max(k)=0 THEN 'system_only' ELSE 'matched' END side FROM (
  SELECT *, 1 f, 0 k FROM (SELECT DISTINCT {s}subject_code stock_code, {q.aligned('party_name')} AS name FROM {parties} WHERE subject_code IN (SELECT stock_code FROM sg))
  UNION ALL SELECT *, 0, 1 FROM ({known})) WHERE name<>'' GROUP BY ALL)"""


FIG = """count(*) FILTER (WHERE side='matched') tp, count(*) FILTER (WHERE side='system_only') fp, count(*) FILTER (WHERE side='gold_only') fn"""


def figures(frm, extra=""):
    return f"""SELECT {extra}tp, fp, fn, CASE WHEN tp+fp>0 THEN tp/(tp+fp) ELSE 0.0::DOUBLE END AS "precision", CASE WHEN tp+fn>0 THEN tp/(tp+fn) ELSE 0.0::DOUBLE END recall,
  CASE WHEN tp>0 THEN 2*(tp/(tp+fp))*(tp/(tp+fn))/((tp/(tp+fp))+(tp/(tp+fn))) ELSE 0.0::DOUBLE END f1 FROM ({frm})"""


def _gold(t):
    return t.once("gold_scoped", lambda: ev.with_scope(t.gold))


def _figures(t, scope="upstream"):
    return ev.figures_under_control(t.outside, t.members, _gold(t), scope)


query("EV1", "SELECT id, scope_class FROM sg", SG)(lambda t: ev.with_scope(t.gold).select("id", "scope_class"))
query("F7", "SELECT id FROM sg WHERE scope_class='upstream'", SG)(lambda t: _gold(t).where("scope_class = 'upstream'").select("id"))
query("A7", """SELECT stock_code, count(*) gold_count, count(*) FILTER (WHERE scope_class='upstream') upstream_count, count(*) FILTER (WHERE scope_class='downstream') downstream_count,
  count(party_entity_id) mapped_count FROM sg GROUP BY 1""", SG)(lambda t: summaries.gold_counts(_gold(t)))
query("A8", """SELECT scope_class, n, n_mapped, CAST(n*10000//sum(n) OVER () AS BIGINT) share_bp, CAST(n_mapped*10000//n AS BIGINT) mapped_bp FROM
  (SELECT scope_class, count(*) n, count(party_entity_id) n_mapped FROM sg GROUP BY 1)""", SG)(lambda t: summaries.scope_shares(_gold(t)))
_DIAG = """SELECT d AS "desc", count(*) n, CASE WHEN d='' THEN 'empty' WHEN contains(d,'其他') THEN 'other'
  WHEN contains(d,'公司') AND NOT regexp_matches(d,'控制|股东|子') THEN 'company' ELSE 'unknown' END diagnosis
  FROM (SELECT trim(coalesce(relation_desc,'')) d FROM sg WHERE scope_class='other') GROUP BY d"""
query("A13", f"SELECT \"desc\", n FROM ({_DIAG}) ORDER BY n DESC, \"desc\" LIMIT 50", SG)(
    lambda t: summaries.top(ev.relation_texts(_gold(t)), 50, F.desc("n"), "desc").select("desc", "n"))
query("EV17", _DIAG, SG)(lambda t: ev.relation_texts(_gold(t)))
_ALL = r.CTES + ",\n" + SG
query("EV2", "SELECT * FROM al", _ALL + ", " + aligned("al", "parties", "upstream"))(
    lambda t: ev.align_under_control(t.outside, t.members, _gold(t), "upstream"))
query("S3", "SELECT * FROM al", _ALL + ", " + aligned("al", "parties"))(
    lambda t: ev.align_under_control(t.outside, t.members, _gold(t)))
query("EV3", figures(f"SELECT {FIG} FROM al"), _ALL + ", " + aligned("al", "parties", "upstream"))(
    lambda t: _figures(t))
_JUDGED = f"""jd AS (SELECT p.*, a.name hit FROM (SELECT subject_code stock_code, rule_id, confidence, {q.aligned('party_name')} AS name FROM parties WHERE subject_code IN (SELECT stock_code FROM sg)) p
  LEFT JOIN (SELECT * FROM al WHERE side='matched') a USING (stock_code, name))"""
_J = _ALL + ", " + aligned("al", "parties", "upstream") + ", " + _JUDGED
query("EV4", """SELECT rule, count(hit) matched, count(*) total, count(hit)/count(*) AS "precision" FROM (SELECT unnest(string_split(rule_id,'+')) rule, hit FROM jd) GROUP BY 1""", _J)(
    lambda t: ev.by_rule(t.found, ev.align(t.found, _gold(t), "upstream")))
query("EV4_confidence", """SELECT confidence, count(hit) matched, count(*) total, count(hit)/count(*) AS "precision" FROM jd GROUP BY 1""", _J)(
    lambda t: ev.by_confidence(t.found, ev.align(t.found, _gold(t), "upstream")))
query("EV5", " UNION ALL ".join(figures(f"SELECT {FIG} FROM al_{n}", f"'{n}' AS scope, ") for n, _ in ev.SCOPES),
      _ALL + ", " + ", ".join(aligned(f"al_{n}", "parties", s) for n, s in ev.SCOPES))(
    lambda t: ev.scope_figures(t.outside, _gold(t), t.members))
_SWEEP = r.cands() + r.cands(tag="low", th=3.0).split("co AS")[0].rstrip().rstrip(",").join([",", ""]) + f""",
st AS MATERIALIZED (SELECT CAST(x AS DOUBLE) setting FROM (VALUES (3.0),(5.0),(7.0),(10.0)) v(x)),
swc AS MATERIALIZED (SELECT setting, c.* FROM c1low c JOIN st ON true JOIN (SELECT stock_code, entity_id, max(ratio) mr FROM holding GROUP BY 1,2) m
   ON m.stock_code=subject_code AND 'E:'||CAST(m.entity_id AS VARCHAR)=party_id WHERE mr IS NULL OR mr>=setting OR mr>=20
  UNION ALL SELECT setting, x.* FROM ({r.UNION.replace('SELECT * FROM c1 UNION ALL ', '')}) x, st),
sw AS MATERIALIZED (SELECT setting, subject_code, party_id, party_name FROM {r.fold('SELECT * FROM swc', 'setting, subject_code, party_id')}),
{SG}, """ + aligned("al", "sw", "upstream", "st")
query("EV6", figures(f"SELECT setting, {FIG} FROM al GROUP BY setting", "setting, "), _SWEEP)(
    lambda t: ev.threshold_sweep(t.runs_outside_control, t.holding, t.entity, _gold(t), members=t.members))
_ABL = r.cands() + f""",
st AS (SELECT unnest(['R1','R2','R3','R4']) setting),
swc AS MATERIALIZED (SELECT setting, x.* FROM ({r.UNION}) x JOIN st ON setting<>'R'||CAST(rule_no AS VARCHAR)),
sw AS MATERIALIZED (SELECT setting, subject_code, party_id, party_name FROM {r.fold('SELECT * FROM swc', 'setting, subject_code, party_id')}),
{SG}, """ + aligned("al", "sw", "upstream", "st")
query("EV7", figures(f"SELECT setting, {FIG} FROM al GROUP BY setting", "setting, "), _ABL)(
    lambda t: ev.rule_ablation(t.pairs, t.company, t.members, _gold(t)))

# ---- reviews and labels, derived from the document labels ----
_REVIEWS = "SELECT doc_id, CASE WHEN quality=1 THEN 'true_omission' WHEN toxic=1 THEN 'system_error' ELSE 'reasonable_undisclosed' END human_class FROM labels"


def _reviews(t):
    c = F.when(F.col("quality") == 1, "true_omission").when(F.col("toxic") == 1, "system_error").otherwise("reasonable_undisclosed")
    return t.raw("labels").select("doc_id", c.alias("human_class"))


_AL_UP = _ALL + ", " + aligned("al", "parties", "upstream")
query("EV8", f"""SELECT n, true_omission, reasonable_undisclosed, system_error, tp, fp, est estimated, tp/(tp+fp) base_precision, (tp+est)/(tp+fp) corrected_precision FROM (
  SELECT *, CAST(fp*true_omission//n AS BIGINT) est FROM (SELECT count(*) n, count(*) FILTER (WHERE human_class='true_omission') true_omission,
  count(*) FILTER (WHERE human_class='reasonable_undisclosed') reasonable_undisclosed, count(*) FILTER (WHERE human_class='system_error') system_error FROM ({_REVIEWS})),
  (SELECT {FIG} FROM al))""".replace("SELECT n, true", "SELECT n, true"), _AL_UP)(
    lambda t: ev.corrected_precision(_reviews(t), _figures(t)))


_SHEET = _AL_UP + f""",
fst AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY subject_code, party_id) first_of FROM (
   SELECT *, {q.aligned('party_name')} AS name FROM parties WHERE subject_code IN (SELECT stock_code FROM al)) p
  WHERE name<>'' AND NOT EXISTS (SELECT 1 FROM al WHERE side='matched' AND al.stock_code=p.subject_code AND al.name=p.name)) WHERE first_of=1),
pieces AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject_code, party_id ORDER BY rule_no, -conf, k1, k2, k3, part) rn FROM (
  SELECT subject_code, party_id, rule_no, conf, k1, k2, k3, 0 part, CASE WHEN rule_no=6 THEN 0 ELSE k1 END pk,
   CASE rule_no WHEN 2 THEN 'actual_controller' WHEN 4 THEN 'position' WHEN 5 THEN 'position' WHEN 7 THEN 'guarantee_pair' ELSE 'holding' END tbl FROM cand SEMI JOIN fst USING (subject_code, party_id)
  UNION ALL SELECT subject_code, party_id, rule_no, conf, k1, k2, k3, 1, k2, CASE rule_no WHEN 2 THEN 'actual_controller' WHEN 4 THEN 'position' ELSE 'holding' END
   FROM cand SEMI JOIN fst USING (subject_code, party_id) WHERE rule_no IN (2,3,4,5))) WHERE rn<=3),
proof AS (SELECT subject_code, party_id, string_agg(tbl||'#'||CAST(pk AS VARCHAR)||' src='||coalesce(CASE WHEN rule_no=6 THEN 'chain' END, source, 'None')||' period='||coalesce(period,'None'), ' | ' ORDER BY rn) evidence
  FROM pieces LEFT JOIN (SELECT DISTINCT 'holding' tbl, id pk, source, report_period period FROM holding UNION ALL SELECT DISTINCT 'position', id, source, NULL FROM position
   UNION ALL SELECT 'actual_controller', id, source, NULL FROM controller UNION ALL SELECT 'guarantee_pair', id, source, event_date FROM guarantee_pair) USING (tbl, pk) GROUP BY 1,2),
told AS (SELECT stock_code, string_agg(party_name, ', ' ORDER BY id) told FROM (SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY id) rn FROM sg WHERE scope_class='upstream') WHERE rn<=15 GROUP BY 1),
spelt AS (SELECT 'E:'||CAST(entity_id AS VARCHAR) party_id, array_to_string(raw_names, ', ') names FROM entity UNION ALL SELECT 'C:'||stock_code, short_name||', '||full_name FROM company)"""


@query("EV9", """SELECT f.subject_code, coalesce(c.short_name, f.subject_code) subject_name, f.party_name, f.rule_id, f.path path_readable, coalesce(evidence,'') evidence, '' report_period,
  f.confidence, f.score_c, coalesce(told,'') gold_parties_of_subject, coalesce(names,'') name_variants FROM fst f LEFT JOIN company c ON c.stock_code=f.subject_code
  LEFT JOIN proof USING (subject_code, party_id) LEFT JOIN told ON told.stock_code=f.subject_code LEFT JOIN spelt USING (party_id)""", _SHEET)
def ev9(t):
    """Review sheet of the undisclosed finds."""
    return ev.review_sheet(t.parties, t.candidates, _gold(t), t.company, t.entity)


_LABELS = "lb AS (SELECT doc_id, quality pred, CAST(doc_id%3<>0 AS INTEGER) gold, CASE WHEN doc_id%2=0 THEN 'high' ELSE 'medium' END tier FROM labels)"


def _labels(t):
    return t.raw("labels").select("doc_id", F.col("quality").alias("pred"), (F.col("doc_id") % 3 != 0).cast("int").alias("gold"),
                                  F.when(F.col("doc_id") % 2 == 0, "high").otherwise("medium").alias("tier"))


_CONF = """SELECT {k}tp, fp, tn, fn, n, (tp+tn)/n accuracy, CASE WHEN tp+fp>0 THEN tp/(tp+fp) ELSE 0.0::DOUBLE END AS "precision", CASE WHEN tp+fn>0 THEN tp/(tp+fn) ELSE 0.0::DOUBLE END recall FROM
 (SELECT {k}count(*) FILTER (WHERE pred=1 AND gold=1) tp, count(*) FILTER (WHERE pred=1 AND gold=0) fp, count(*) FILTER (WHERE pred=0 AND gold=0) tn,
  count(*) FILTER (WHERE pred=0 AND gold=1) fn, count(*) n FROM lb {g})"""
query("EV10", _CONF.format(k="", g=""), _LABELS)(lambda t: ev.confusion(_labels(t)))
query("EV10_tier", _CONF.format(k="tier, ", g="GROUP BY tier"), _LABELS)(lambda t: ev.confusion(_labels(t), ["tier"]))
query("EV11", """SELECT doc_id, CAST(pred AS VARCHAR) left_label, CASE WHEN doc_id%5<>0 THEN CAST(gold AS VARCHAR) END right_label,
  CASE WHEN doc_id%5=0 THEN '' WHEN pred=gold THEN 'agree' ELSE 'DISAGREE' END cross_check FROM lb""", _LABELS)(
    lambda t: ev.agreement(_labels(t).select("doc_id", F.col("pred").cast("string").alias("label")),
                           _labels(t).where("doc_id % 5 <> 0").select("doc_id", F.col("gold").cast("string").alias("label")), "doc_id"))
query("EV12", """SELECT doc_id, arg_min(label, (-n, label)) AS label, max(n) n, CAST(max(n)>=2 AS INTEGER) has_majority FROM (SELECT doc_id, label, count(*) n FROM
  (SELECT doc_id, pred AS label FROM lb UNION ALL SELECT doc_id, gold FROM lb UNION ALL SELECT doc_id, CAST(doc_id%4 AS INTEGER) FROM lb) GROUP BY 1,2) GROUP BY 1""", _LABELS)(
    lambda t: ev.majority(_labels(t).select("doc_id", F.col("pred").alias("label")).unionAll(_labels(t).select("doc_id", "gold")).unionAll(
        _labels(t).select("doc_id", (F.col("doc_id") % 4).cast("int"))), "doc_id"))

# ---- graded answers: every company asked for its holders, answered with some of them ----
_QA = f"""qa AS (SELECT CAST(stock_code AS BIGINT) id, CASE CAST(stock_code AS BIGINT)%3 WHEN 0 THEN 'fact_query' WHEN 1 THEN 'relation_explain' ELSE 'open_qa' END intent, stock_code FROM company),
ex AS (SELECT CAST(stock_code AS BIGINT) id, display_name||'有限公司' AS name FROM holding JOIN entity USING (entity_id) WHERE holder_rank<=2),
an AS (SELECT CAST(stock_code AS BIGINT) id, CASE CAST(stock_code AS BIGINT)%4 WHEN 0 THEN '未发现关联' WHEN 1 THEN '存在关联' ELSE '股东有'||(SELECT min(display_name) FROM holding h JOIN entity USING (entity_id)
  WHERE h.stock_code=c.stock_code AND holder_rank=1) END answer, CASE WHEN CAST(stock_code AS BIGINT)%5=0 THEN 0 WHEN CAST(stock_code AS BIGINT)%7=0 THEN NULL ELSE 1 END vp, CAST(stock_code AS BIGINT)%2 nv FROM company c),
gr AS (SELECT q.id, q.intent, k AS kind, CASE k WHEN 'names' THEN CAST(hits>=1 AS INTEGER) WHEN 'bool' THEN CAST((contains(answer,'关联') AND NOT contains(answer,'未发现') AND NOT contains(answer,'无关联'))=(q.id%2=1) AS INTEGER) END correct,
  CASE WHEN k='names' THEN CAST(hits>0 AS INTEGER) ELSE CAST(vp IS NOT NULL AS INTEGER) END cited, coalesce(vp,1) verify_passed, CAST(coalesce(vp,1)=0 AND nv>0 AS INTEGER) hallucination FROM
  (SELECT *, CASE intent WHEN 'fact_query' THEN 'names' WHEN 'relation_explain' THEN 'bool' ELSE 'manual' END k FROM qa) q JOIN an USING (id) LEFT JOIN
  (SELECT id, count(*) FILTER (WHERE contains({q.norm('answer')}, {q.org('name')})) hits FROM ex JOIN an USING (id) GROUP BY 1) h USING (id))"""


def _graded(t):
    k = F.col("stock_code").cast("bigint")
    intent = F.when(k % 3 == 0, "fact_query").when(k % 3 == 1, "relation_explain").otherwise("open_qa")
    kind = F.when(k % 3 == 0, "names").when(k % 3 == 1, "bool").otherwise("manual")
    qa = t.company.select(k.alias("id"), intent.alias("intent"), kind.alias("kind"), F.lit(1).alias("min_match"),
                          (k % 2).cast("int").alias("expected_bool"))
    named = t.holding.join(t.entity.select("entity_id", "display_name"), "entity_id")
    expected = named.where("holder_rank <= 2").select(k.alias("id"), F.concat("display_name", F.lit("有限公司")).alias("name"))
    best = named.where("holder_rank = 1").groupBy("stock_code").agg(F.min("display_name").alias("best"))
    answer = F.when(k % 4 == 0, "未发现关联").when(k % 4 == 1, "存在关联").otherwise(F.concat(F.lit("股东有"), "best"))
    answers = t.company.join(best, "stock_code", "left").select(
        k.alias("id"), answer.alias("answer"), F.when(k % 5 == 0, 0).when(k % 7 == 0, None).otherwise(1).alias("verify_passed"),
        (k % 2).alias("n_violations"))
    return ev.graded(qa, expected, answers)


query("EV13", "SELECT * FROM gr", _QA)(_graded)
query("EV13_rates", """SELECT intent, count(correct) n_graded, CAST(sum(correct) AS BIGINT) n_correct, CAST(sum(cited) AS BIGINT) n_cited, CAST(sum(verify_passed) AS BIGINT) n_passed,
  CAST(sum(hallucination) AS BIGINT) n_hallucinated, count(*) n, CASE WHEN count(correct)>0 THEN CAST(sum(correct) AS BIGINT)/count(correct) ELSE 0.0::DOUBLE END accuracy
  FROM gr GROUP BY GROUPING SETS ((intent), ())""", _QA)(lambda t: ev.grade_rates(_graded(t)))


_SET = f"""pool AS (SELECT DISTINCT stock_code FROM controller ORDER BY 1 LIMIT 30), named AS (SELECT entity_id, display_name FROM entity WHERE is_channel=0 AND display_name IS NOT NULL),
seq AS (SELECT entity_id, min(stock_code) a, max(stock_code) b FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY stock_code) rn FROM controller) WHERE rn<=2 GROUP BY 1 HAVING min(stock_code)<>max(stock_code)),
ring AS (SELECT a, lead(a) OVER (ORDER BY entity_id) b FROM (SELECT * FROM seq ORDER BY md5('42:'||CAST(entity_id AS VARCHAR)) LIMIT 11)),
rel AS (SELECT a, b, 'true' expected FROM (SELECT * FROM seq ORDER BY entity_id LIMIT 10) UNION ALL SELECT a, b, 'false' FROM ring WHERE b IS NOT NULL)"""


@query("EV14", f"""SELECT 'fact_query' AS intent, stock_code AS code, stock_code||'的前十大股东是谁' AS question, 'names' AS kind, string_agg(display_name, '|' ORDER BY rn) AS expected FROM
   (SELECT stock_code, display_name, row_number() OVER (PARTITION BY stock_code ORDER BY id) rn FROM holding JOIN pool USING (stock_code) JOIN named USING (entity_id) WHERE source='{S.BATCH_SOURCE}') WHERE rn<=5 GROUP BY stock_code
  UNION ALL SELECT 'fact_query', stock_code, stock_code||'的实控人是谁', 'names', string_agg(display_name, '|' ORDER BY id) FROM controller JOIN pool USING (stock_code) JOIN named USING (entity_id) GROUP BY stock_code
  UNION ALL SELECT 'related_party', stock_code, stock_code||'的关联方有哪些', 'names', string_agg(party_name, '|' ORDER BY id) FROM gold WHERE stock_code IN (SELECT DISTINCT stock_code FROM gold ORDER BY 1 LIMIT 30) GROUP BY stock_code
  UNION ALL SELECT 'relation_explain', a, a||'和'||b||'是什么关系', 'bool', expected FROM rel""", _SET)
def ev14(t):
    """Question set with expected answers."""
    return ev.qa_set(t.holding, t.controller, t.entity, t.gold)


query("EV15", f"""SELECT n_other, tp, fn, e estimated_upstream, tp/(tp+fn) recall, tp/(tp+fn+e) corrected_recall FROM (SELECT *, CAST(n_other*8//30 AS BIGINT) e FROM
  (SELECT count(*) FILTER (WHERE scope_class='other') n_other FROM sg), (SELECT {FIG} FROM al))""", _AL_UP)(
    lambda t: ev.recall_if_other_were_upstream(_gold(t), _figures(t), 8, 30))
query("EV18", f"SELECT min(doc_id) doc_id, human_class FROM ({_REVIEWS}) GROUP BY 2")(lambda t: ev.first_cases(_reviews(t), ["doc_id"]))
