"""Linking, intents, slots and references over tables of questions."""
from pyspark.sql import functions as F

from kinweave import settings as S
from kinweave.catalog import sqlkit as q
from kinweave.catalog.registry import query
from kinweave.operators import summaries
from kinweave.plans import linking as ln, questions as qs

_Q = "(SELECT question_id id, question AS text FROM question)"


def _questions(t):
    return t.question.select(F.col("question_id").alias("id"), F.col("question").alias("text"))


WORDS = f"""cw AS (SELECT word, count(*) n_codes, min(code) code FROM (SELECT DISTINCT {q.matcher('n')} word, stock_code code FROM
 (SELECT short_name n, stock_code FROM company UNION ALL SELECT full_name, stock_code FROM company)) WHERE length(word)>=2 GROUP BY 1),
pw AS (SELECT word, count(*) n_codes, min(code) code FROM (SELECT DISTINCT {q.matcher('display_name')} word, entity_id code FROM entity WHERE entity_type='person' AND is_channel=0)
 WHERE length(word)>=2 GROUP BY 1),
qn AS (SELECT id, text, {q.matcher('text')} n FROM {_Q}),
hit AS (SELECT id, word, n_codes, code, strpos(n, word) pos, length(word) len FROM qn JOIN cw ON contains(n, word)),
codes AS (SELECT id, unnest([x for x in regexp_split_to_array(text,'\\D+') if length(x)=6]) c, text FROM qn),
hit2 AS (SELECT * FROM hit UNION ALL SELECT DISTINCT id, c, 1, c, strpos(text, c), 6 FROM codes WHERE c IN (SELECT stock_code FROM company)),
m1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos, -len) rn FROM hit2) WHERE rn=1),
m2 AS (SELECT * FROM (SELECT h.*, row_number() OVER (PARTITION BY h.id ORDER BY h.pos, -h.len) rn FROM hit2 h JOIN m1 ON m1.id=h.id AND h.pos>=m1.pos+m1.len) WHERE rn=1),
phit AS (SELECT id, word, n_codes, code, strpos(n, word) pos, length(word) len FROM qn JOIN pw ON contains(n, word)),
p1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY -len, pos) rn FROM phit) WHERE rn=1),
p2 AS (SELECT * FROM (SELECT h.*, row_number() OVER (PARTITION BY h.id ORDER BY -h.len, h.pos) rn FROM phit h JOIN p1 ON p1.id=h.id AND h.word<>p1.word AND (h.pos>=p1.pos+p1.len OR h.pos+h.len<=p1.pos)) WHERE rn=1),
fc AS (SELECT id, c FROM (SELECT id, c, row_number() OVER (PARTITION BY id ORDER BY strpos(text,c)) rn FROM codes) WHERE rn=1 AND c IN (SELECT stock_code FROM company)),
lm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY -len, pos) rn FROM hit) WHERE rn=1),
cm AS (SELECT id, c word, 1 n_codes, c code, 'code_exact' AS method FROM fc UNION ALL SELECT id, word, n_codes, CASE WHEN n_codes=1 THEN code END,
 CASE WHEN n_codes>1 THEN 'dict_ambiguous' WHEN length(word)<=8 THEN 'dict_short_name' ELSE 'dict_full_name' END FROM lm WHERE id NOT IN (SELECT id FROM fc))"""

query("J9", "SELECT id, CAST(pos AS INTEGER) pos, word FROM hit", WORDS)(
    lambda t: ln.occurrences(ln._normed(_questions(t), "id", "text"), ln.words(ln.company_dictionary(t.company)), "id", "_norm").select("id", "pos", "word"))
_NAMED = f"""cp AS (SELECT lpad(CAST(id AS VARCHAR),6,'0') code, name AS short_name FROM holder_name)"""
query("LNK4", f"""SELECT word, count(*) n_codes, min(code) code FROM (SELECT DISTINCT {q.matcher('short_name')} word, code FROM cp WHERE length({q.matcher('short_name')})>=2
  UNION ALL SELECT * FROM (SELECT DISTINCT {q.matcher(q.alias('short_name'))} word, code FROM cp) WHERE length(word)>=2 AND word NOT IN (SELECT {q.matcher('short_name')} FROM cp)) GROUP BY 1""", _NAMED)(
    lambda t: ln.words(ln.company_dictionary(t.holder_name.select(F.lpad(F.col("id").cast("string"), 6, "0").alias("stock_code"),
                                                                  F.col("name").alias("short_name"), F.lit(None).cast("string").alias("full_name")))))
query("LNK5", "SELECT id, word, CAST(n_codes AS BIGINT) n_codes, code, method FROM cm", WORDS)(lambda t: ln.company_match(_questions(t), t.company))
query("LNK6", "SELECT m1.id, m1.word word_1, m1.n_codes n_codes_1, m1.code code_1, m2.word word_2, m2.n_codes n_codes_2, m2.code code_2 FROM m1 LEFT JOIN m2 USING (id)", WORDS)(
    lambda t: ln.first_two_matches(_questions(t), t.company))
query("LNK7", f"""SELECT id, word, n_codes, CASE WHEN n_codes=1 THEN code END code FROM (SELECT id, word, n_codes, code, row_number() OVER (PARTITION BY id ORDER BY -length(word), strpos(n,word)) rn FROM
  (SELECT statement_id id, {q.matcher('text')} n FROM statement) JOIN pw ON contains(n, word)) WHERE rn=1""", WORDS)(
    lambda t: ln.person_match(t.statement.select(F.col("statement_id").alias("id"), "text"), t.entity))

_LINK_TEXTS = """lt AS (SELECT DISTINCT trim(x) t FROM (SELECT unnest([s_name, upper(s_name), s_name||'股份有限公司', lpad(CAST(s_suppkey AS VARCHAR),6,'0'), left(s_name,17), s_name||'Ｂ', '不存在'||s_name]) x FROM supplier
 UNION ALL SELECT unnest([c_name, upper(c_name), c_name||' 有限公司', left(c_name, 17)]) FROM customer))"""


def _link_texts(t):
    s, c = t.raw("supplier"), t.raw("customer")
    a = s.select(F.explode(F.array(
        F.col("s_name"), F.upper("s_name"), F.concat("s_name", F.lit("股份有限公司")), F.lpad(F.col("s_suppkey").cast("string"), 6, "0"),
        F.left("s_name", F.lit(17)), F.concat("s_name", F.lit("Ｂ")), F.concat(F.lit("不存在"), "s_name"))).alias("text"))
    b = c.select(F.explode(F.array(F.col("c_name"), F.upper("c_name"), F.concat("c_name", F.lit(" 有限公司")), F.left("c_name", F.lit(17)))).alias("text"))
    return a.unionAll(b)


LC = f"""lc AS (SELECT t AS text, m AS method, CASE m WHEN 'exact_code' THEN t WHEN 'short_name_exact' THEN c2 WHEN 'full_name_exact' THEN c3 WHEN 'normalized' THEN c4 END code,
 CASE WHEN m='fuzzy' THEN cs END candidates, CAST(m='short_name_ambiguous' OR (m='fuzzy' AND n5>1) AS INTEGER) clarify FROM (SELECT *, CASE WHEN n1=1 THEN 'exact_code' WHEN n2=1 THEN 'short_name_exact'
  WHEN n2>1 THEN 'short_name_ambiguous' WHEN n3=1 THEN 'full_name_exact' WHEN n4=1 THEN 'normalized' WHEN n5>0 THEN 'fuzzy' ELSE 'not_found' END m FROM (SELECT t,
  (SELECT count(*) FROM company WHERE stock_code=t) n1, (SELECT count(*) FROM company WHERE short_name=t) n2, (SELECT min(stock_code) FROM company WHERE short_name=t) c2,
  (SELECT count(*) FROM company WHERE full_name=t) n3, (SELECT min(stock_code) FROM company WHERE full_name=t) c3,
  (SELECT count(*) FROM company WHERE lower(short_name)=lower({q.norm('t')})) n4, (SELECT min(stock_code) FROM company WHERE lower(short_name)=lower({q.norm('t')})) c4, coalesce(n5,0) n5, cs
  FROM lt LEFT JOIN (SELECT t, count(*) n5, string_agg(stock_code, ',' ORDER BY stock_code) cs FROM (SELECT t, stock_code, row_number() OVER (PARTITION BY t ORDER BY stock_code) rn FROM lt JOIN company ON contains(lower(short_name), lower(t)))
   WHERE rn<=5 GROUP BY 1) USING (t))))"""
query("LNK1", "SELECT * FROM lc", _LINK_TEXTS + ", " + LC)(lambda t: ln.link_company(_link_texts(t), t.company))

LE = f"""lv AS (SELECT entity_id, lower(display_name) d, lower(canonical_name) c FROM entity WHERE is_channel=0),
kk AS (SELECT c, min(entity_id) e FROM lv GROUP BY 1 HAVING count(*)=1),
cn1 AS (SELECT t, min(short_name) cname FROM lt JOIN company ON lower(short_name)=lower(t) GROUP BY 1 HAVING count(*)=1),
via AS (SELECT t, min(entity_id) e FROM cn1 JOIN lv ON d=lower(cname) GROUP BY 1),
pre AS (SELECT t, e FROM (SELECT t, e.entity_id e, row_number() OVER (PARTITION BY t ORDER BY n DESC, e.entity_id) rn FROM cn1 JOIN entity e ON is_channel=0 AND starts_with(display_name, cname)
 JOIN (SELECT entity_id, count(*) n FROM holding GROUP BY 1) h ON h.entity_id=e.entity_id) WHERE rn=1),
le AS (SELECT t AS text, m AS method, CASE m WHEN 'company_name->entity' THEN e1 WHEN 'company_fuzzy+hold_count' THEN e2 WHEN 'display_name_exact' THEN e3 WHEN 'normalized' THEN e4 END entity_id,
 CASE WHEN m='fuzzy' THEN cs END candidates, CAST(m='ambiguous' OR (m='fuzzy' AND n5>1) AS INTEGER) clarify FROM (SELECT *, CASE WHEN e1 IS NOT NULL THEN 'company_name->entity' WHEN e2 IS NOT NULL THEN 'company_fuzzy+hold_count'
  WHEN n3=1 THEN 'display_name_exact' WHEN n3>1 THEN 'ambiguous' WHEN e4 IS NOT NULL THEN 'normalized' WHEN n5>0 THEN 'fuzzy' ELSE 'not_found' END m FROM (SELECT t, via.e e1, pre.e e2,
  (SELECT count(*) FROM lv WHERE d=lower(t)) n3, (SELECT min(entity_id) FROM lv WHERE d=lower(t)) e3,
  coalesce((SELECT e FROM kk WHERE c=lower({q.norm('t')})), (SELECT e FROM kk WHERE c=lower({q.org('t')})), (SELECT e FROM kk WHERE c=lower(t))) e4, coalesce(n5,0) n5, cs
  FROM lt LEFT JOIN via USING (t) LEFT JOIN pre USING (t) LEFT JOIN (SELECT t, count(*) n5, string_agg(CAST(entity_id AS VARCHAR), ',' ORDER BY entity_id) cs FROM (SELECT t, entity_id, row_number() OVER (PARTITION BY t ORDER BY entity_id) rn
   FROM lt JOIN lv ON contains(d, lower(t))) WHERE rn<=5 GROUP BY 1) USING (t))))"""
query("LNK2", "SELECT * FROM le", _LINK_TEXTS + ", " + LE)(lambda t: ln.link_entity(_link_texts(t), t.company, t.entity, t.holding))
query("J8", "SELECT text, method FROM lc WHERE method<>'not_found'", _LINK_TEXTS + ", " + LC)(
    lambda t: ln.link_company(_link_texts(t), t.company).where("method <> 'not_found'").select("text", "method"))


def _w(k):
    return q.any_word("s", S.INTENT_WORDS[k])


def _h(k):
    return f"({_w(k)} OR regexp_matches(s, {q.lit('|'.join(f'^(?:{p})' for p in S.INTENT_PATTERNS[k]))}))"


_TWO_NAMES = S.TWO_NAMES.replace(r"\u4e00-\u9fa5", "一-龥")
INTENT = f"""it AS (SELECT id, text, CASE WHEN {_w('Q8')} THEN 'Q8|95|compare_keyword' WHEN {_h('Q6')} THEN 'Q6|95|keyword/pattern' WHEN regexp_matches(s, '{S.TWO_CODES}') AND {_w('Q2')} THEN 'Q2|95|two_code+keyword'
 WHEN regexp_matches(s, '{_TWO_NAMES}') AND {_w('Q2')} THEN 'Q2|85|two_entity+keyword' WHEN regexp_matches(s, {q.lit('|'.join('^(?:' + p + ')' for p in S.INTENT_PATTERNS['Q3']))}) THEN 'Q3|90|pattern'
 WHEN {_w('Q3')} AND regexp_matches(s,'哪些|哪家') THEN 'Q3|85|keyword+哪些' WHEN {_h('Q5')} THEN 'Q5|90|keyword/pattern' WHEN {_h('Q4')} THEN 'Q4|90|keyword/pattern' WHEN {_h('Q1')} THEN 'Q1|90|keyword/pattern'
 ELSE 'Q7|30|fallback' END r FROM (SELECT id, text, trim(text) s FROM {_Q})),
itn AS (SELECT id, text, split_part(r,'|',1) intent, CAST(split_part(r,'|',2) AS INTEGER) confidence, split_part(r,'|',3) rule_hit, CAST(split_part(r,'|',1)='Q7' AS INTEGER) uncertain FROM it)"""
query("INT1", "SELECT id, intent, confidence, rule_hit, uncertain FROM itn", INTENT)(
    lambda t: _questions(t).select("id", qs.intent(F.col("text")).alias("r")).select("id", "r.*"))
query("INT2", f"""SELECT id, CASE WHEN regexp_matches(text,'{S.TWO_CODES}') AND regexp_matches(text,'{S.SIMPLE_RELATIONSHIP}') THEN 'relation_explain' WHEN regexp_matches(text,'{S.SIMPLE_RELATION}') THEN 'related_party'
  WHEN regexp_matches(text,'{S.SIMPLE_FACT}') THEN 'fact_query' ELSE 'open_qa' END intent FROM {_Q}""")(
    lambda t: _questions(t).select("id", qs.simple_intent(F.col("text")).alias("intent")))


def _asked(t):
    ctx = F.when(F.col("turn") > 0, F.col("session"))
    return t.question.select(F.col("question_id").alias("id"), F.col("question").alias("text"), ctx.alias("context_code")).withColumn(
        "intent", qs.intent(F.col("text"))["intent"])


def _slots(t):
    return qs.slots(_asked(t), t.company, t.entity)


_ROLE = " ".join(f"WHEN contains(text,'{w}') THEN '{r}'" for w, r in sorted(S.ROLE_WORDS.items(), key=lambda kv: -len(kv[0])))
SLOTS = WORDS + ",\n" + INTENT + f""",
sl0 AS (SELECT i.id, i.text, intent, CASE WHEN turn>0 THEN session END ctx, cm.word cword, cm.code ccode, m1.n_codes n1, m1.code k1, m2.n_codes n2, m2.code k2, m1.word w1, m2.word w2,
  p1.word pa, p1.n_codes pn, p1.code pe, p2.word pb FROM itn i JOIN question ON question_id=i.id LEFT JOIN cm ON cm.id=i.id LEFT JOIN m1 ON m1.id=i.id LEFT JOIN m2 ON m2.id=i.id LEFT JOIN p1 ON p1.id=i.id LEFT JOIN p2 ON p2.id=i.id),
sl1 AS (SELECT *, CASE WHEN cword IS NOT NULL THEN coalesce(ccode,'') ELSE ctx END comp, [x for x in [CASE WHEN w1 IS NOT NULL THEN CASE WHEN n1=1 THEN k1 ELSE '' END END, CASE WHEN w2 IS NOT NULL THEN CASE WHEN n2=1 THEN k2 ELSE '' END END] if x IS NOT NULL] ft FROM sl0),
sl2 AS (SELECT *, CASE WHEN len(ft)<2 AND ctx IS NOT NULL THEN list_append(ft, ctx) ELSE ft END bo, coalesce(CASE WHEN pn=1 THEN CAST(pe AS VARCHAR) END, pa, cword) ent FROM sl1),
sl AS (SELECT id, intent, CASE WHEN intent IN ('Q1','Q4','Q5') THEN comp END company,
  CASE WHEN intent='Q2' THEN CASE WHEN len(bo)>=2 THEN bo[1] WHEN pa IS NOT NULL AND (pb IS NOT NULL OR len(bo)>=1) THEN pa END END entity_a,
  CASE WHEN intent='Q2' THEN CASE WHEN len(bo)>=2 THEN bo[2] WHEN pa IS NOT NULL THEN coalesce(pb, bo[1]) END END entity_b,
  CASE WHEN intent='Q3' THEN ent END entity, CASE WHEN intent='Q3' AND ent IS NOT NULL THEN CASE WHEN contains(text,'控制') THEN 'control' WHEN regexp_matches(text,'持股|持有') THEN 'hold' WHEN regexp_matches(text,'任职|担任') THEN 'serve' END END relation_type,
  CASE WHEN intent='Q4' AND comp IS NOT NULL THEN CASE {_ROLE} ELSE 'all' END END role_type,
  CASE WHEN intent='Q5' AND comp IS NOT NULL THEN array_to_string(list_sort(list_distinct([x for x in [CASE WHEN contains(text,'担保') THEN 'guarantee' END, CASE WHEN regexp_matches(text,'诉讼|法律纠纷') THEN 'lawsuit' END, CASE WHEN contains(text,'质押') THEN 'pledge' END] if x IS NOT NULL])),',') END event_types,
  CASE WHEN intent IN ('Q6','Q8') AND len(bo)>=2 THEN bo[1] END company_a, CASE WHEN intent IN ('Q6','Q8') AND len(bo)>=2 THEN bo[2] END company_b,
  CAST(coalesce(CASE WHEN intent IN ('Q1','Q4','Q5') THEN cword IS NOT NULL AND ccode IS NULL WHEN intent IN ('Q2','Q6','Q8') THEN list_contains(bo[1:2],'') WHEN intent='Q3' THEN CASE WHEN pa IS NOT NULL THEN pn>1 ELSE cword IS NOT NULL AND ccode IS NULL END END, false) AS INTEGER) clarify FROM sl2)"""
query("SLT1", "SELECT *, CAST(coalesce(company, entity_a, entity, company_a) IS NOT NULL AS INTEGER) filled FROM sl", SLOTS)(_slots)
CELLS = (SLOTS + """, cells AS (SELECT *, regexp_full_match(i,'\\d+') AND (length(i)=6 OR slot='entity') g FROM (SELECT id, 'company' slot, company i FROM sl WHERE company IS NOT NULL UNION ALL SELECT id, 'entity_a', entity_a FROM sl WHERE entity_a IS NOT NULL
  UNION ALL SELECT id, 'entity_b', entity_b FROM sl WHERE entity_b IS NOT NULL UNION ALL SELECT id, 'entity', entity FROM sl WHERE entity IS NOT NULL
  UNION ALL SELECT id, 'company_a', company_a FROM sl WHERE intent='Q6' AND company_a IS NOT NULL UNION ALL SELECT id, 'company_b', company_b FROM sl WHERE intent='Q6' AND company_b IS NOT NULL)),
lt AS (SELECT DISTINCT trim(i) t FROM cells WHERE NOT g), """ + LC + ", " + LE)
query("SLT2", f"""SELECT id, slot, i AS input, CASE WHEN g THEN i WHEN left(slot,1)='c' THEN lc.code ELSE CAST(le.entity_id AS VARCHAR) END AS value,
  CASE WHEN g THEN 'given' WHEN left(slot,1)='c' THEN lc.method ELSE le.method END AS method, CASE WHEN g OR (left(slot,1)='c' AND lc.code IS NOT NULL) OR (left(slot,1)='e' AND le.entity_id IS NOT NULL) THEN 'linked'
  WHEN (left(slot,1)='c' AND lc.clarify=1) OR (left(slot,1)='e' AND le.clarify=1) THEN 'clarify' ELSE 'error' END state FROM cells LEFT JOIN lc ON lc.text=i LEFT JOIN le ON le.text=i""",
      CELLS)(
    lambda t: qs.link_slots(_slots(t), t.company, t.entity, t.holding))

# ---- references: the question log of a session, its mentions, and the first holders as results of every third turn ----
_LOG = WORDS + """,
men AS (SELECT session, turn, 0 ord, code, code AS name FROM cm JOIN question ON question_id=id WHERE code IS NOT NULL),
res AS (SELECT session, turn, CAST(rk-1 AS INTEGER) pos, CAST(entity_id AS VARCHAR) code, display_name AS name FROM question JOIN (SELECT stock_code, entity_id, min(holder_rank) hr, row_number() OVER (PARTITION BY stock_code ORDER BY min(id)) rk FROM holding
  GROUP BY 1,2) ON stock_code=session AND rk<=3 JOIN entity USING (entity_id) WHERE turn%3=1),
rows AS (SELECT question_id id, q.session, q.turn, question AS text, CAST(cm.code IS NOT NULL AS INTEGER) he FROM question q LEFT JOIN cm ON cm.id=question_id)"""


def _session_log(t):
    found = ln.company_match(_questions(t), t.company).where("code IS NOT NULL").select(F.col("id").alias("question_id"), "code")
    rows = t.question.join(found, "question_id", "left")
    log = rows.select(F.col("question_id").alias("id"), "session", "turn", F.col("question").alias("text"),
                      F.col("code").isNotNull().cast("int").alias("has_entity"))
    mentions = rows.where("code IS NOT NULL").select("session", "turn", F.lit(0).alias("ord"), "code", F.col("code").alias("name"))
    firsts = t.holding.groupBy("stock_code", "entity_id").agg(F.min("id").alias("first_id"))
    top = summaries.first_per_key(firsts, ["stock_code"], ["first_id"], 3).join(t.entity.select("entity_id", "display_name"), "entity_id")
    results = t.question.where("turn % 3 = 1").join(top, F.col("stock_code") == F.col("session")).select(
        "session", "turn", (F.col("rank") - 1).alias("pos"), F.col("entity_id").cast("string").alias("code"), F.col("display_name").alias("name"))
    return log, mentions, results


_PRON = " ".join(f"WHEN contains(text,'{p}') THEN '{p}'" for p in S.PRONOUNS)
_ORD = " ".join(f"WHEN contains(text,'{w}') THEN {n}" for w, n in sorted(S.ORDINALS.items(), key=lambda kv: -len(kv[0])))
REFS = _LOG + f""",
rf AS (SELECT r.id, r.session, r.turn, CASE {_PRON} END pron, CASE {_ORD} END ord, he=0 AND {q.any_word('text', S.OMISSION_WORDS)} om,
  (SELECT count(DISTINCT code) FROM men m WHERE m.session=r.session AND m.turn BETWEEN r.turn-4 AND r.turn-1) nc,
  (SELECT arg_max(code, turn) FROM men m WHERE m.session=r.session AND m.turn BETWEEN r.turn-4 AND r.turn-1) top,
  (SELECT arg_min(code, (turn,pos)) FROM res m WHERE m.session=r.session AND m.turn BETWEEN r.turn-4 AND r.turn-1) rtop,
  (SELECT count(*) FROM res m WHERE m.session=r.session AND m.turn=r.turn-1) nl FROM rows r),
rk AS (SELECT *, CASE WHEN pron IS NOT NULL THEN 'pronoun' WHEN ord IS NOT NULL THEN 'ordinal' WHEN om THEN 'omission' ELSE 'none' END kind FROM rf),
rt AS (SELECT id, session, turn, kind, CASE kind WHEN 'pronoun' THEN CASE WHEN nc<=1 THEN coalesce(top,rtop) END WHEN 'omission' THEN coalesce(top,rtop)
  WHEN 'ordinal' THEN (SELECT code FROM res m WHERE m.session=rk.session AND m.turn=rk.turn-1 AND m.pos=CASE WHEN ord<0 THEN nl+ord ELSE ord END) END target FROM rk)"""
_REF = "SELECT id, session, CAST(turn AS INTEGER) turn, kind, target, CAST(target IS NOT NULL AS INTEGER) resolved, CAST(kind<>'none' AND target IS NULL AS INTEGER) clarify FROM rt"
for _id, _kind in (("COR1", "ordinal"), ("COR2", "pronoun"), ("COR3", "omission")):
    query(_id, f"SELECT * FROM ({_REF}) WHERE kind='{_kind}'", REFS)(
        lambda t, k=_kind: qs.references(*_session_log(t)).where(F.col("kind") == k))


#: The log in which every turn after results also names the first of them, and the longest name found in each question.
_NAMED_REFS = _LOG + f""",
nm AS MATERIALIZED (SELECT r.id, r.session, r.turn, coalesce(f.name||'那个呢', r.text) AS text, he FROM rows r LEFT JOIN res f ON f.session=r.session AND f.turn=r.turn-1 AND f.pos=0),
fw AS MATERIALIZED (SELECT id, session, turn, word FROM (SELECT id, session, turn, word, row_number() OVER (PARTITION BY id ORDER BY -length(word), strpos(n, word)) rn
  FROM (SELECT id, session, turn, {q.matcher('text')} n FROM nm) JOIN (SELECT DISTINCT lower(display_name) word FROM entity) ON contains(n, word)) WHERE rn=1),
pt AS MATERIALIZED (SELECT f.id, count(DISTINCT m.pos) np, min(m.code) pc FROM fw f JOIN res m ON m.session=f.session AND m.turn=f.turn-1
  WHERE contains({q.norm('m.name')}, word) OR contains({q.matcher('m.name')}, word) GROUP BY 1)""" + REFS[len(_LOG):].replace("FROM rows r)", "FROM nm r)").replace(
    "ELSE 'none' END kind FROM rf)", "WHEN np>=1 THEN 'name_fragment' ELSE 'none' END kind FROM rf LEFT JOIN pt USING (id))").replace(
    "CASE kind WHEN 'pronoun'", "CASE kind WHEN 'name_fragment' THEN CASE WHEN np=1 THEN pc END WHEN 'pronoun'")


@query("COR4", _REF, _NAMED_REFS)
def cor4(t):
    """As COR1-3 with name fragments of earlier results; every turn also names the first result by its number."""
    log, mentions, results = _session_log(t)
    named = log.join(results.where("pos = 0").select("session", (F.col("turn") + 1).alias("turn"), F.col("name").alias("n")), ["session", "turn"], "left")
    named = named.withColumn("text", F.when(F.col("n").isNotNull(), F.concat("n", F.lit("那个呢"))).otherwise(F.col("text"))).drop("n")
    everyone = t.entity.select(F.lower("display_name").alias("word"), F.col("entity_id").alias("code"))
    found = ln.longest_match(named.select("id", "text"), everyone).select("id", "word")
    return qs.references(named, mentions, results, found)


_SQLS = """CASE o_orderkey%9 WHEN 0 THEN 'SELECT * FROM company LIMIT 10' WHEN 1 THEN 'select e.password from entity e limit 5' WHEN 2 THEN 'SELECT * FROM evil_' || o_orderstatus || ' LIMIT 10'
 WHEN 3 THEN 'DELETE FROM company' WHEN 4 THEN 'SELECT h.ratio FROM holding h JOIN entity e ON h.entity_id=e.entity_id LIMIT ' || CAST(o_custkey AS STRING) WHEN 5 THEN 'SELECT stock_code FROM position'
 WHEN 6 THEN 'SELECT 1; drop table event' WHEN 7 THEN 'SELECT * FROM event LIMIT 200' ELSE 'SELECT c.short_name FROM COMPANY c LIMIT 201' END"""
query("SQL1", f"""SELECT o_orderkey, CASE WHEN bt IS NOT NULL THEN '非法表名: '||bt WHEN bc IS NOT NULL THEN '非法列名: '||bc ELSE 'OK' END structure, CASE WHEN w<>'' THEN '禁止的关键字: '||w ELSE 'OK' END readonly,
  CASE WHEN NOT contains(upper(s),'LIMIT') THEN '缺少 LIMIT 子句' WHEN l<>'' AND CAST(l AS BIGINT)>200 THEN 'LIMIT 过大: '||l||' (>200)' ELSE 'OK' END resource FROM (SELECT *,
  [x for x in regexp_extract_all(s,'(?i)(?:FROM|JOIN)\\s+(\\w+)',1) if lower(x) NOT IN {q.in_list(S.SQL_TABLES)}][1] bt,
  [x for x in regexp_extract_all(s,'([a-zA-Z_]\\w*\\.[a-zA-Z_]\\w*)',1) if lower(split_part(x,'.',2)) NOT IN {q.in_list(S.SQL_COLUMNS)}][1] bc,
  regexp_extract(s,'(?i){S.SQL_FORBIDDEN}',1) w, regexp_extract(s,'(?i)LIMIT\\s+(\\d+)',1) l FROM (SELECT o_orderkey, {_SQLS} s FROM orders))""")(
    lambda t: qs.audit_sql(t.raw("orders").select("o_orderkey", F.expr(_SQLS).alias("sql"))).drop("sql"))
