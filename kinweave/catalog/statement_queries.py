"""Statements checked against the tables, and parties found in report text."""
from pyspark.sql import functions as F

from kinweave import settings as S
from kinweave.catalog import sqlkit as q
from kinweave.catalog.question_queries import WORDS
from kinweave.catalog.registry import query
from kinweave.functions import text as tx
from kinweave.plans import lookups, statements as st


def _statements(t):
    return t.statement.select(F.col("statement_id").alias("id"), "text")


_ST = "stt AS (SELECT statement_id id, text FROM statement)"
_RUN = f"[^{''.join(w for w in S.MENTION_STOP_WORDS if len(w) == 1)}{S.MENTION_BREAK}]".replace("\\s", "\\s")
# Suspected names by positions instead of by splitting: every place of a suffix, the 20 characters before it, their last unbroken run.
_SUS = f"""suf AS (SELECT unnest({q.in_list(S.MENTION_SUFFIXES).replace('(', '[').replace(')', ']')}) sx),
plc AS (SELECT id, sx, text, unnest(range(1, length(text)-length(sx)+2)) p FROM stt JOIN suf ON contains(text, sx)),
men AS (SELECT DISTINCT id, regexp_extract(substr(text, CAST(greatest(1, p-20) AS BIGINT), CAST(p-greatest(1, p-20) AS BIGINT)), {q.lit('(' + _RUN + '*)$')}, 1)||sx mention FROM plc WHERE substr(text, CAST(p AS BIGINT), length(sx))=sx),
sus AS (SELECT id, mention FROM men WHERE length(mention)>=4 AND {q.norm('mention')} NOT IN {q.in_list(S.MENTION_GENERIC)})"""
query("TXT1", "SELECT id, mention FROM sus", _ST + ", " + _SUS)(
    lambda t: st.mentions(_statements(t)))
_VALS = f"""vals AS (SELECT id, 'percent' AS kind, unnest(regexp_extract_all(text, '{S.PERCENT_PATTERN}', 1)) AS value FROM stt UNION ALL
 SELECT id, 'amount', unnest([x[1]||'|'||x[2] for x in list_zip(regexp_extract_all(text, '{S.AMOUNT_PATTERN}', 1), regexp_extract_all(text, '{S.AMOUNT_PATTERN}', 2))]) FROM stt UNION ALL
 SELECT id, 'count', unnest(regexp_extract_all(text, '{S.COUNT_PATTERN}', 1)) FROM stt UNION ALL
 SELECT id, 'date', unnest([y[i]||'-'||lpad(m[i],2,'0')||CASE WHEN d[i]<>'' THEN '-'||lpad(d[i],2,'0') ELSE '' END for i in range(1, len(y)+1)]) FROM
  (SELECT id, regexp_extract_all(text, '{S.DATE_PATTERN}', 1) y, regexp_extract_all(text, '{S.DATE_PATTERN}', 2) m, regexp_extract_all(text, '{S.DATE_PATTERN}', 3) d FROM stt))"""
query("TXT2", "SELECT * FROM vals", _ST + ", " + _VALS)(lambda t: st.values(_statements(t)))
_RESULT = """hol AS (SELECT stock_code, max(ratio) ratio FROM holding JOIN entity USING (entity_id) GROUP BY stock_code, display_name, entity_type, is_channel
 QUALIFY row_number() OVER (PARTITION BY stock_code ORDER BY min(id), display_name, entity_type)<=10),
con AS (SELECT stock_code, control_ratio FROM controller JOIN entity USING (entity_id) WHERE is_channel=0),
eve AS (SELECT subject_code stock_code, amount, event_date FROM event)"""
query("TXT3", """SELECT DISTINCT * FROM (SELECT stock_code, 'percent' AS kind, ratio AS number, CAST(NULL AS VARCHAR) AS value FROM hol WHERE ratio IS NOT NULL UNION ALL SELECT stock_code, 'percent', control_ratio, NULL FROM con
  UNION ALL SELECT stock_code, 'amount', amount, NULL FROM eve WHERE amount IS NOT NULL UNION ALL SELECT stock_code, 'date', NULL, event_date FROM eve
  UNION ALL SELECT stock_code, 'count', NULL, CAST(count(*) AS VARCHAR) FROM hol GROUP BY 1 UNION ALL SELECT stock_code, 'count', NULL, CAST(count(*) AS VARCHAR) FROM eve GROUP BY 1
  UNION ALL SELECT stock_code, 'count', NULL, CAST(CAST(trunc(ratio) AS BIGINT) AS VARCHAR) FROM hol WHERE ratio IS NOT NULL UNION ALL SELECT stock_code, 'count', NULL, CAST(CAST(trunc(control_ratio) AS BIGINT) AS VARCHAR) FROM con
  UNION ALL SELECT stock_code, 'count', NULL, CAST(CAST(trunc(amount) AS BIGINT) AS VARCHAR) FROM eve WHERE amount IS NOT NULL)""", _RESULT)(
    lambda t: st.result_values(lookups.holders(t.holding, t.entity), lookups.controllers(t.controller, t.entity),
                               t.event.withColumnRenamed("subject_code", "stock_code")))
_ALLOWED = """alw AS (SELECT statement_id id, 'percent' AS kind, ratio AS number, CAST(NULL AS VARCHAR) AS value FROM statement UNION ALL SELECT statement_id, 'amount', 1234.5, NULL FROM statement
 UNION ALL SELECT statement_id, 'count', NULL, CAST(n_rows AS VARCHAR) FROM statement UNION ALL SELECT statement_id, 'date', NULL, report_period||'-01' FROM statement)"""


def _allowed(t):
    s = t.statement
    row = lambda k, n, v: F.struct(F.lit(k).alias("kind"), n.cast("double").alias("number"), v.cast("string").alias("value"))
    none = F.lit(None)
    return s.select(F.col("statement_id").alias("id"), F.explode(F.array(
        row("percent", F.col("ratio"), none), row("amount", F.lit(1234.5), none), row("count", none, F.col("n_rows")),
        row("date", none, F.concat("report_period", F.lit("-01"))))).alias("x")).select("id", "x.*")


_WRONG = """wr AS (SELECT id, kind, value FROM vals v WHERE NOT EXISTS (SELECT 1 FROM alw a WHERE a.id=v.id AND a.kind=v.kind AND CASE v.kind
  WHEN 'percent' THEN abs(CAST(v.value AS DOUBLE)-a.number)<0.1 WHEN 'amount' THEN abs(TRY_CAST(split_part(v.value,'|',1) AS DOUBLE)-a.number)<0.01
  WHEN 'count' THEN CAST(v.value AS BIGINT)=CAST(a.value AS BIGINT) ELSE v.value=a.value END))"""
query("TXT4", "SELECT * FROM wr", _ST + ", " + _VALS + ", " + _ALLOWED + ", " + _WRONG)(
    lambda t: st.wrong_values(st.values(_statements(t)), _allowed(t)))
_UNKNOWN = f"""known AS (SELECT word FROM cw UNION SELECT word FROM pw),
cand AS (SELECT DISTINCT mention, {q.norm('mention')} cn, lower({q.norm('mention')}) k FROM sus),
unk AS (SELECT mention FROM cand WHERE k NOT IN (SELECT word FROM known) AND NOT EXISTS (SELECT 1 FROM known WHERE length(word)>=3 AND (contains(k, word) OR contains(word, k)))
 AND NOT EXISTS (SELECT 1 FROM entity WHERE lower(canonical_name) IN (k, lower({q.org_of_norm('cn')}))) AND NOT (length(k)>=6 AND EXISTS (SELECT 1 FROM entity WHERE is_channel=0 AND contains(lower(display_name), k)))),
uc AS (SELECT id, mention FROM sus JOIN unk USING (mention))"""
query("TXT5", "SELECT id, mention FROM uc", WORDS + ", " + _ST + ", " + _SUS + ", " + _UNKNOWN)(
    lambda t: st.unknown_companies(_statements(t), t.company, t.entity))
_UCODE = """ucode AS (SELECT id, x stock_code FROM (SELECT id, unnest([y for y in regexp_split_to_array(text,'\\D+') if length(y)=6]) x FROM stt) WHERE x NOT IN (SELECT stock_code FROM company))"""
query("TXT6", "SELECT * FROM ucode", _ST + ", " + _UCODE)(lambda t: st.unknown_codes(_statements(t), t.company))
_WORDING = "wd AS (" + " UNION ALL ".join(f"SELECT id, '{n}' AS kind, left(unnest(regexp_extract_all(text, '{p}')),50) AS value FROM stt" for n, p in S.WORDING_CLASSES) + ")"
query("TXT7", "SELECT * FROM wd", _ST + ", " + _WORDING)(lambda t: st.wording(_statements(t)))
query("TXT8", """SELECT id, coalesce(v,0) violations, coalesce(e,0) wording, CAST(coalesce(v,0)=0 AND coalesce(e,0)=0 AS INTEGER) passed FROM stt LEFT JOIN
  (SELECT id, CAST(sum(v) AS BIGINT) v, CAST(sum(e) AS BIGINT) e FROM (SELECT id, 1 v, 0 e FROM uc UNION ALL SELECT id, 1, 0 FROM ucode UNION ALL SELECT id, 1, 0 FROM wr UNION ALL SELECT id, 0, 1 FROM wd) GROUP BY 1) USING (id)""",
      ", ".join([WORDS, _ST, _SUS, _UNKNOWN, _UCODE, _VALS, _ALLOWED, _WRONG, _WORDING]))(
    lambda t: st.verdicts(_statements(t), t.company, t.entity, _allowed(t)))

# ---- names and events extracted from documents ----
_NAMED_DOC = "nd AS (SELECT doc_id, text, CASE doc_id%4 WHEN 0 THEN ' '||regexp_extract(text,'(\\w{8,})',1) WHEN 1 THEN 'Nobody Ltd' WHEN 2 THEN left(text,9) ELSE '' END AS name FROM documents)"


def _named_docs(t):
    k = F.col("doc_id") % 4
    word = F.regexp_extract("text", r"([0-9A-Za-z_]{8,})", 1)
    return t.raw("documents").select("doc_id", "text", F.when(k == 0, F.concat(F.lit(" "), word)).when(k == 1, "Nobody Ltd").when(
        k == 2, F.left("text", F.lit(9))).otherwise("").alias("name"))


query("TXT9", f"SELECT doc_id, name FROM nd WHERE contains(text, name) OR contains({q.norm('text')}, {q.norm('name')})", _NAMED_DOC)(
    lambda t: _named_docs(t).where(st.in_text(F.col("name"), F.col("text"))).select("doc_id", "name"))
query("TXT10", f"SELECT id, unnest(list_distinct([trim(x) for x in regexp_extract_all(text, {q.lit(S.ORG_IN_TEXT)}, 1)])) AS name FROM (SELECT * FROM stt UNION ALL SELECT -doc_id-1, text FROM documents)", _ST)(
    lambda t: st.organisations(_statements(t).unionAll(t.raw("documents").select(-F.col("doc_id") - 1, "text"))))


def _pages(t):
    return t.raw("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "text"))


query("TXT11", f"""SELECT doc_id, name, CAST(coalesce(min(CASE WHEN n<>'' AND contains({q.norm('pt')}, n) THEN pg END), min(CASE WHEN contains(pt, name) THEN pg END))+1 AS INTEGER) page FROM
  (SELECT doc_id, name, {q.norm('name')} n, unnest(string_split(text, chr(10))) pt, unnest(range(len(string_split(text, chr(10))))) pg FROM nd) GROUP BY 1,2""", _NAMED_DOC)(
    lambda t: st.first_page(_pages(t), _named_docs(t).select("doc_id", "name")))
# Report lines: a document's lines, 2 per page from page 12 on, some turned into headers and boundaries.
_LINE = """CASE WHEN doc_id % 3 = 0 AND n = 20 + doc_id % 7 THEN '第十节 关联方及关联交易' WHEN doc_id % 2 = 0 AND n = 30 + doc_id % 11 THEN '十一、其他重要事项'
 WHEN doc_id % 3 = 1 AND n % 9 = 4 THEN '涉及关联交易的说明' || line ELSE line END"""


def _lines(t):
    d = t.raw("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return d.select("doc_id", F.expr("12 + n div 2").cast("int").alias("page"), F.expr(_LINE).alias("line"))


query("TXT12", f"""SELECT np.doc_id, coalesce(h.s, sc.s) AS start, CASE WHEN h.s IS NOT NULL THEN coalesce(b.e, least(h.s+20, np.n)) ELSE sc.e END AS "end", CASE WHEN h.s IS NOT NULL THEN 'regex' WHEN sc.s IS NOT NULL THEN 'scatter' ELSE 'none' END AS method FROM np
  LEFT JOIN h USING (doc_id) LEFT JOIN (SELECT l.doc_id, min(page) e FROM bd l JOIN h ON h.doc_id=l.doc_id AND page>h.s AND page<=h.s+20 WHERE length(trim(line))<30 AND regexp_matches(trim(line), {q.lit(S.SECTION_BOUNDARY)}) GROUP BY 1) b USING (doc_id)
  LEFT JOIN (SELECT doc_id, min(page) s, max(page)+1 e FROM (SELECT DISTINCT doc_id, page, dense_rank() OVER (PARTITION BY doc_id ORDER BY page) r FROM bd WHERE regexp_matches(line,'关联方|关联交易') AND doc_id NOT IN (SELECT doc_id FROM h)) GROUP BY 1) sc USING (doc_id)""",
      f"""dl AS (SELECT doc_id, unnest(string_split(text, chr(10))) line, unnest(range(len(string_split(text, chr(10))))) n FROM documents),
ll AS (SELECT doc_id, CAST(12+n//2 AS INTEGER) page, {_LINE} line FROM dl), np AS (SELECT doc_id, CAST(max(page)+1 AS INTEGER) n FROM ll GROUP BY 1),
bd AS (SELECT ll.* FROM ll JOIN np USING (doc_id) WHERE page>=20 AND page<np.n),
h AS (SELECT doc_id, min(page) s FROM bd WHERE length(trim(line))<40 AND {q.any_word('trim(line)', S.SECTION_HEADERS)} GROUP BY 1)""")(
    lambda t: st.locate_section(_lines(t), _lines(t).groupBy("doc_id").agg((F.max("page") + 1).alias("n_pages"))))

_CELL = """CASE WHEN r = 0 THEN CASE c WHEN 0 THEN CASE WHEN c_custkey % 3 = 0 THEN '关联方余额' ELSE '序号' END WHEN 1 THEN CASE WHEN c_custkey % 4 = 0 THEN '项目' ELSE ' 关联方名称' END ELSE CASE WHEN c_custkey % 5 = 0 THEN '备注' ELSE '与本公司关系' END END
 ELSE CASE c WHEN 1 THEN CASE (c_custkey + r) % 5 WHEN 0 THEN '合计' WHEN 1 THEN '子公司' WHEN 2 THEN '甲' ELSE c_name || '有限公司' END WHEN 2 THEN '联营' ELSE CAST(r AS STRING) END END"""


def _cells(t):
    rc = t.raw("customer").select("c_custkey", "c_name", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("r"))
    rc = rc.select("c_custkey", "c_name", "r", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("c"))
    return rc.select(F.col("c_custkey").alias("doc_id"), F.lit(1).alias("page"), F.lit(0).alias("tbl"), F.col("r").alias("row"), F.col("c").alias("col"),
                     F.expr(_CELL).alias("text"))


query("TXT13", f"""SELECT doc_id, 1 AS page, 0 AS tbl, CAST(r AS INTEGER) AS "row", pn party_name, coalesce(rd,'') relation_desc FROM (SELECT doc_id, r, max(CASE WHEN c=nc THEN trim(tx) END) pn, max(CASE WHEN c=rc THEN trim(tx) END) rd FROM cl JOIN
   (SELECT doc_id, min(CASE WHEN contains(tx,'关联方') AND NOT regexp_matches(tx,'金额|比例|余额|日期|占') THEN c END) nc, min(CASE WHEN regexp_matches(tx,'关系|性质') THEN c END) rc FROM cl WHERE r=0 GROUP BY 1) USING (doc_id)
  WHERE r>0 AND nc IS NOT NULL GROUP BY 1,2) WHERE length(pn)>=2 AND pn NOT IN {q.in_list(S.TABLE_STOP_ROWS)}""",
      f"cl AS (SELECT c_custkey doc_id, r, c, {_CELL} tx FROM (SELECT c_custkey, c_name, unnest(range(4)) r FROM customer), (SELECT unnest(range(3)) c))")(
    lambda t: st.party_rows(_cells(t)).select("doc_id", "page", "tbl", "row", "party_name", "relation_desc"))
_EX = "ex AS (SELECT doc_id id, text, CASE doc_id%4 WHEN 0 THEN 'lawsuit' WHEN 1 THEN 'rumour' WHEN 2 THEN 'penalty' ELSE 'guarantee' END event_type, name AS counterparty, CASE WHEN doc_id%5=0 THEN 'nan' WHEN doc_id%7=0 THEN 'x' ELSE CAST(n_chars AS VARCHAR) END amount, text summary, CASE WHEN doc_id%2=0 THEN '2024-05-06T00' ELSE '' END event_date FROM (SELECT nd.*, n_chars FROM nd JOIN documents USING (doc_id)))"


def _extracted(t):
    k = F.col("doc_id")
    d = _named_docs(t).join(t.raw("documents").select("doc_id", "n_chars"), "doc_id")
    return d.select(k.alias("id"), "text", F.when(k % 4 == 0, "lawsuit").when(k % 4 == 1, "rumour").when(k % 4 == 2, "penalty").otherwise("guarantee").alias("event_type"),
                    F.col("name").alias("counterparty"), F.when(k % 5 == 0, "nan").when(k % 7 == 0, "x").otherwise(F.col("n_chars").cast("string")).alias("amount"),
                    F.col("text").alias("summary"), F.when(k % 2 == 0, "2024-05-06T00").otherwise("").alias("event_date"))


query("TXT14", f"""SELECT id, CASE WHEN event_type IN {q.in_list(S.EXTRACTED_EVENT_TYPES)} THEN event_type ELSE 'other' END event_type, nullif(trim(counterparty),'') counterparty,
  CASE WHEN NOT isnan(TRY_CAST(amount AS DOUBLE)) THEN TRY_CAST(amount AS DOUBLE) END amount, left(summary,200) summary, nullif(substr(event_date,1,10),'') event_date, 'llm_extracted' source_type FROM ex
  WHERE trim(counterparty)='' OR contains(text, trim(counterparty)) OR contains({q.norm('text')}, {q.norm('counterparty')})""", _NAMED_DOC + ", " + _EX)(
    lambda t: st.extracted_events(_extracted(t)))
_TITLE = """CASE o_orderkey % 6 WHEN 0 THEN '2024年年度报告 ' WHEN 1 THEN '2024年半年度报告' WHEN 2 THEN '2023年年度报告摘要' WHEN 3 THEN '2023年年度报告' WHEN 4 THEN '2023年H股年度报告' ELSE '关于年度报告的公告' END"""


def _announcements(t):
    o = t.raw("orders")
    return o.select(F.lpad(F.col("o_custkey").cast("string"), 6, "0").alias("stock_code"), F.expr(_TITLE).alias("title"),
                    F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("time"),
                    F.concat(F.lit("http://x/detail?announcementId="), F.col("o_orderkey").cast("string"), F.lit("&t=1")).alias("url"))


query("TXT15", f"""SELECT stock_code, trim(title) title, "time", 'http://static.cninfo.com.cn/finalpage/'||substr("time",1,10)||'/'||k||'.PDF' pdf_url, CAST(row_number() OVER (PARTITION BY stock_code ORDER BY "time" DESC, url) AS INTEGER) newest FROM
  (SELECT lpad(CAST(o_custkey AS VARCHAR),6,'0') stock_code, {_TITLE} title, strftime(o_orderdate,'%Y-%m-%d %H:%M:%S') "time", CAST(o_orderkey AS VARCHAR) k, 'http://x/detail?announcementId='||CAST(o_orderkey AS VARCHAR)||'&t=1' url FROM orders)
  WHERE trim(title) LIKE '%年度报告' AND NOT regexp_matches(title,'半年度|摘要|英文|更正|修订|补丁|H股')""")(lambda t: st.annual_reports(_announcements(t)))
