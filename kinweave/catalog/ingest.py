"""Feeds, merges, sinks. The feeds are spelled the way they arrive, over the rows of the warehouse."""
from pyspark.sql import functions as F

from kinweave import settings as S
from kinweave.catalog import sqlkit as q
from kinweave.catalog.registry import query
from kinweave.functions import names
from kinweave.sources import feeds, merges

# ---- feeds ----
_HOLDER_FEED = {
    "股票代码": "CAST(c_custkey % 100 AS STRING)", "股票简称": "'*名' || CAST(c_custkey % 100 AS STRING)", "报告期": "'2025-12-31 00:00'",
    "股东名称": None, "股东类型": None, "期末持股-数量": "CASE WHEN c_custkey % 5 = 0 THEN 'nan' ELSE CAST(c_custkey * 10 AS STRING) END",
    "序号": "CAST(c_custkey % 10 AS STRING) || '.0'",
}


def _feed(df, spec):
    return df.select(*[F.expr(e).alias(h) for h, e in spec.items() if e])


def _holder_feed(t):
    named = t.holder_name.select(F.col("id"), F.col("name").alias("股 东名称"), F.col("holder_type").alias("股东类型"))
    spec = {h: e for h, e in _HOLDER_FEED.items() if e}
    rest = t.raw("customer").select("c_custkey", *[F.expr(e).alias(h) for h, e in spec.items()])
    return rest.join(named, rest.c_custkey == named.id).drop("id", "c_custkey")


@query("SRC1", "SELECT lpad(CAST(s_suppkey AS VARCHAR),6,'0') stock_code, s_name short_name FROM supplier")
def src1(t):
    return feeds.load_companies(t.raw("supplier").select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("name")))


@query("SRC2", f"""SELECT lpad(CAST(id%100 AS VARCHAR),6,'0') stock_code, '*名'||CAST(id%100 AS VARCHAR) company_name, ty entity_type,
  {q.canonical('ty', 'name')} canonical_name, name display_name, CAST({q.channel('name')} AS INTEGER) is_channel,
  CASE WHEN {q.channel('name')} THEN 'medium' ELSE 'high' END confidence, '2025-12-31' report_period,
  CASE WHEN id%5<>0 THEN CAST(id*10 AS DOUBLE) END shares, CAST(NULL AS DOUBLE) ratio, CAST(id%10 AS INTEGER) holder_rank,
  '{S.BATCH_SOURCE}' source, '2025-12-31' valid_from FROM (SELECT *, {q.holder_type('holder_type', 'name')} ty FROM holder_name)""")
def src2(t):
    return feeds.load_holdings(_holder_feed(t))


_CHANGE_FEED = {
    "代码": "CAST(o_custkey % 100 AS STRING)", "名称": "'股' || CAST(o_custkey % 100 AS STRING)",
    "股东名称": "CASE o_orderkey % 11 WHEN 0 THEN 'nan' WHEN 1 THEN '' ELSE '王 ' || CAST(o_custkey AS STRING) END",
    "变动截止日": "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END",
    "公告日": "CASE WHEN o_orderkey % 2 = 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) || 'T00' END",
    "变动后持股情况-持股总数": "CAST(o_orderkey AS STRING)", "变动后持股情况-占总股本比例": "CASE WHEN o_orderkey % 7 = 0 THEN '-' ELSE CAST(o_orderkey % 100 AS STRING) END",
    "变动开始日": "CASE WHEN o_orderkey % 4 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) END",
}


@query("SRC3", """SELECT lpad(CAST(o_custkey%100 AS VARCHAR),6,'0') stock_code, '股'||CAST(o_custkey%100 AS VARCHAR) company_name, 'person' entity_type,
  '王'||CAST(o_custkey AS VARCHAR) canonical_name, '王 '||CAST(o_custkey AS VARCHAR) display_name, 0 is_channel, 'medium' confidence,
  CASE WHEN o_orderkey%3<>0 OR o_orderkey%2=0 THEN d ELSE '' END report_period, CAST(o_orderkey AS DOUBLE) shares,
  CASE WHEN o_orderkey%7<>0 THEN CAST(o_orderkey%100 AS DOUBLE) END ratio, CAST(NULL AS INTEGER) holder_rank,
  'stock_ggcg_em' source, CASE WHEN o_orderkey%4<>0 THEN d ELSE '' END valid_from
  FROM (SELECT *, strftime(o_orderdate,'%Y-%m-%d') d FROM orders WHERE o_orderkey%11 NOT IN (0,1))""")
def src3(t):
    return feeds.load_exec_changes(_feed(t.raw("orders"), _CHANGE_FEED))


_POSITION_FEED = {
    "股票代码": "CASE o_orderkey % 4 WHEN 0 THEN 'SH' || CAST(o_custkey % 100 AS STRING) WHEN 1 THEN NULL WHEN 2 THEN 'nan' ELSE CAST(o_custkey % 100 AS STRING) END",
    "股票名称": "'Supplier#' || lpad(CAST(o_custkey % 120 AS STRING), 9, '0') || ' '",
    "变动人": "'赵' || CAST(o_custkey AS STRING)",
    "董监高职务": "CASE o_orderkey % 5 WHEN 0 THEN '董事' WHEN 1 THEN '' WHEN 2 THEN '监事' WHEN 3 THEN '独立董事' ELSE 'nan' END",
    "变动日期": "CAST(CAST(o_orderdate AS DATE) AS STRING)",
}


@query("SRC4", f"""SELECT lpad(code,6,'0') stock_code, sname company_name, 'person' entity_type, '赵'||CAST(o_custkey AS VARCHAR) canonical_name,
  '赵'||CAST(o_custkey AS VARCHAR) display_name, 0 is_channel, 'low' confidence, CASE m WHEN 0 THEN '董事' WHEN 2 THEN '监事' ELSE '独立董事' END title,
  CASE m WHEN 0 THEN 'director' WHEN 2 THEN 'supervisor' ELSE 'independent_director' END title_class, '{S.POSITION_SOURCE}' source,
  strftime(o_orderdate,'%Y-%m-%d') valid_from FROM (SELECT *, o_orderkey%5 m, 'Supplier#'||lpad(CAST(o_custkey%120 AS VARCHAR),9,'0')||' ' sname,
   CASE WHEN o_orderkey%4 IN (0,3) THEN CAST(o_custkey%100 AS VARCHAR) ELSE (SELECT stock_code FROM company WHERE short_name=
    'Supplier#'||lpad(CAST(o_custkey%120 AS VARCHAR),9,'0')) END code FROM orders) WHERE code IS NOT NULL AND m IN (0,2,3)""")
def src4(t):
    return feeds.load_positions(_feed(t.raw("orders"), _POSITION_FEED), t.company)[1]


_CONTROLLER_FEED = {
    "证券代码": "CAST(c_custkey % 100 AS STRING)", "证券简称": "'简称'",
    "变动日期": "'2024-06-30 00:00'", "实际控制人 名称": "CASE c_custkey % 6 WHEN 0 THEN '无' WHEN 1 THEN ' ; ' WHEN 2 THEN '顾雄' || CAST(c_custkey % 10 AS STRING) || ';力源股份;'"
    " WHEN 3 THEN c_name || '集团有限公司' || chr(13) || '某某' WHEN 4 THEN '国资委' ELSE c_name END",
    "控股比例": "CAST(c_custkey % 70 AS STRING)", "控制类型": "'单独控制'",
}


@query("SRC5", f"""SELECT lpad(CAST(c_custkey%100 AS VARCHAR),6,'0') stock_code, '简称' company_name, ty entity_type, {q.canonical('ty', 'n')} canonical_name,
  n display_name, 'high' confidence, '控制类型=单独控制; chain_tokens='||CASE WHEN c_custkey%6 IN (2,3) THEN '2' ELSE '1' END disambig_note,
  CAST(c_custkey%70 AS DOUBLE) control_ratio, '{S.CONTROLLER_SOURCE}' source, '2024-06-30' valid_from FROM (SELECT *, {q.controller_type('n')} ty FROM
   (SELECT c_custkey, CASE c_custkey%6 WHEN 2 THEN '顾雄'||CAST(c_custkey%10 AS VARCHAR) WHEN 3 THEN c_name||'集团有限公司' WHEN 4 THEN '国资委'
    ELSE c_name END n FROM customer WHERE c_custkey%6 NOT IN (0,1)))""")
def src5(t):
    return feeds.load_controllers(_feed(t.raw("customer"), _CONTROLLER_FEED))


def _event_feed(count, amount):
    return {"证券代码": "CAST(o_custkey AS STRING)", count: "o_orderkey % 9",
            amount: "CASE WHEN o_orderkey % 6 = 0 THEN 'NaN' ELSE CAST(o_orderkey AS STRING) END", "公告统计区间": "'2023-2025'"}


_EVENT_SQL = """SELECT '{kind}' event_type, lpad(CAST(o_custkey AS VARCHAR),6,'0') subject_code, CASE WHEN o_orderkey%6<>0 THEN CAST(o_orderkey AS DOUBLE) END amount,
  CAST(o_orderkey%9 AS VARCHAR)||'{unit}' summary, '2023-2025' event_date, 'structured' source_type FROM orders"""
query("SRC6", _EVENT_SQL.format(kind="guarantee", unit="笔"))(
    lambda t: feeds.load_guarantees(_feed(t.raw("orders"), _event_feed("担保 笔数", "担保金额"))))
query("SRC7", _EVENT_SQL.format(kind="lawsuit", unit="次"))(
    lambda t: feeds.load_lawsuits(_feed(t.raw("orders"), _event_feed("诉讼次数", "诉讼金额"))))

_PLEDGE_FEED = {
    "股票代码": "CAST(o_custkey % 100 AS STRING)", "公告日期": "'2024-01-01'", "质押数量": "CAST(o_orderkey AS STRING)", "质押事项": "'质押'",
    "出质人": "CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'CUSTOMER#' || lpad(CAST(o_custkey AS STRING), 9, '0') || ' 有限公司' "
            "WHEN 2 THEN '查无此人' ELSE 'Customer#' || lpad(CAST(o_custkey AS STRING), 9, '0') END",
    "质权人": "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE '银行' END",
}


@query("SRC8", """SELECT 'pledge' event_type, lpad(CAST(o_custkey%100 AS VARCHAR),6,'0') subject_code,
  CASE WHEN p<>'' OR b<>'' THEN p||' -> '||b END counterparty, CAST(o_orderkey AS DOUBLE) amount, '质押' summary, '2024-01-01' event_date,
  'structured' source_type, (SELECT min(entity_id) FROM entity WHERE canonical_name=lower(k)) counterparty_entity_id FROM (SELECT *,
   CASE o_orderkey%5 WHEN 0 THEN '' WHEN 1 THEN 'CUSTOMER#'||lpad(CAST(o_custkey AS VARCHAR),9,'0')||' 有限公司' WHEN 2 THEN '查无此人'
    ELSE 'Customer#'||lpad(CAST(o_custkey AS VARCHAR),9,'0') END p, CASE WHEN o_orderkey%5=0 OR o_orderkey%5=2 THEN ''
    ELSE 'customer#'||lpad(CAST(o_custkey AS VARCHAR),9,'0') END k, CASE WHEN o_orderkey%10=0 THEN '' ELSE '银行' END b FROM orders)""")
def src8(t):
    return feeds.load_pledges(_feed(t.raw("orders"), _PLEDGE_FEED), t.entity)


# ---- merges: order rows arrive in order-key order ----
_COMPANY_ROWS = ("SELECT lpad(CAST(o_custkey AS VARCHAR),6,'0') stock_code, 'N'||CAST(o_orderkey AS VARCHAR) short_name, "
                 "CASE WHEN o_orderkey%3=0 THEN 'F'||CAST(o_orderkey AS VARCHAR) END full_name, CASE WHEN o_orderkey%4=0 THEN o_orderpriority END industry, "
                 "CASE WHEN o_orderkey%5=0 THEN strftime(o_orderdate,'%Y-%m-%d') END list_date, CASE WHEN o_orderkey%2=0 THEN o_totalprice END market_cap, "
                 "CAST(o_orderkey%2 AS INTEGER) is_st, o_orderkey seq FROM orders")


def _company_rows(t):
    o = t.raw("orders")
    k = F.col("o_orderkey")
    return o.select(
        F.lpad(F.col("o_custkey").cast("string"), 6, "0").alias("stock_code"), F.concat(F.lit("N"), k.cast("string")).alias("short_name"),
        F.when(k % 3 == 0, F.concat(F.lit("F"), k.cast("string"))).alias("full_name"),
        F.when(k % 4 == 0, F.col("o_orderpriority")).alias("industry"),
        F.when(k % 5 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("list_date"),
        F.when(k % 2 == 0, F.col("o_totalprice")).alias("market_cap"), (k % 2).cast("int").alias("is_st"), k.alias("seq"))


_KNOWN = "max_by({c}, seq) FILTER (WHERE {c} IS NOT NULL) {c}"


@query("MRG1", "SELECT stock_code, max_by(short_name,seq) short_name, " + ", ".join(
    _KNOWN.format(c=c) for c in ("full_name", "industry", "list_date", "market_cap")) +
    f", max_by(is_st,seq) is_st FROM ({_COMPANY_ROWS}) GROUP BY 1")
def mrg1(t):
    return merges.merge_company(_company_rows(t))


_ENTITY_ROWS = f"""SELECT id seq, ty entity_type, {q.canonical('ty', 'name')} canonical_name, CASE WHEN id%3<>0 THEN name END display_name,
  CASE WHEN id%4<>0 THEN name END raw_name, CAST({q.channel('name')} AS INTEGER) is_channel, CASE WHEN id%2=0 THEN 'high' ELSE 'low' END confidence,
  CASE WHEN id%5=0 THEN 'note'||CAST(id AS VARCHAR) END disambig_note FROM (SELECT *, {q.holder_type('holder_type', 'name')} ty FROM holder_name)"""


def _entity_rows(t):
    typed = t.holder_name.withColumn("n", names.normalize_name("name")).withColumn(
        "entity_type", names.holder_type_of_normalized(names.normalize_name("holder_type"), F.col("n")))
    i = F.col("id")
    return typed.select(
        i.alias("seq"), "entity_type", names.canonical_of_normalized("entity_type", F.col("n")).alias("canonical_name"),
        F.when(i % 3 != 0, F.col("name")).alias("display_name"), F.when(i % 4 != 0, F.col("name")).alias("raw_name"),
        names.is_channel_name("name", normalized=F.col("n")).cast("int").alias("is_channel"), F.when(i % 2 == 0, "high").otherwise("low").alias("confidence"),
        F.when(i % 5 == 0, F.concat(F.lit("note"), i.cast("string"))).alias("disambig_note"))


@query("MRG2", """SELECT entity_type, canonical_name, max(is_channel) is_channel, max(CASE WHEN rn=1 THEN display_name END) display_name,
  max(CASE WHEN rn=1 THEN confidence END) confidence, max(CASE WHEN rn=1 THEN disambig_note END) disambig_note,
  (SELECT string_agg(s, '|' ORDER BY a) FROM (SELECT s, min(seq) a FROM keyed k WHERE k.entity_type=r.entity_type AND k.canonical_name=r.canonical_name
    AND s IS NOT NULL GROUP BY s)) raw_names FROM keyed r GROUP BY 1,2""",
       ctes=f"""keyed AS (SELECT *, CASE WHEN rn=1 THEN coalesce(raw_name,display_name,canonical_name) ELSE raw_name END s FROM
  (SELECT *, row_number() OVER (PARTITION BY entity_type,canonical_name ORDER BY seq) rn FROM ({_ENTITY_ROWS})))""")
def mrg2(t):
    return merges.build_entities(_entity_rows(t)).withColumn("raw_names", F.array_join("raw_names", "|"))


def _holding_rows(t):
    o, k = t.raw("orders"), F.col("o_orderkey")
    return o.select(
        (F.col("o_custkey") % 50).alias("entity_id"), F.lpad((F.col("o_custkey") % 7).cast("string"), 6, "0").alias("stock_code"),
        F.year("o_orderdate").cast("string").alias("report_period"), F.when(k % 2 == 0, F.col("o_totalprice")).alias("shares"),
        F.when(k % 3 == 0, (k % 100).cast("double")).alias("ratio"), F.when(k % 5 == 0, (k % 10).cast("int")).alias("holder_rank"),
        F.when(k % 7 == 0, "2001-01-01").alias("valid_to"), F.concat(F.lit("s"), (k % 3).cast("string")).alias("source"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("valid_from"), k.alias("seq"))


@query("MRG3", f"""SELECT entity_id, stock_code, report_period, {', '.join(_KNOWN.format(c=c) for c in ('shares', 'ratio', 'holder_rank', 'valid_to'))},
  min_by(source,seq) source, min_by(valid_from,seq) valid_from FROM (SELECT o_custkey%50 entity_id, lpad(CAST(o_custkey%7 AS VARCHAR),6,'0') stock_code,
  CAST(year(o_orderdate) AS VARCHAR) report_period, CASE WHEN o_orderkey%2=0 THEN o_totalprice END shares, CASE WHEN o_orderkey%3=0 THEN CAST(o_orderkey%100 AS DOUBLE) END ratio,
  CASE WHEN o_orderkey%5=0 THEN CAST(o_orderkey%10 AS INTEGER) END holder_rank, CASE WHEN o_orderkey%7=0 THEN '2001-01-01' END valid_to,
  's'||CAST(o_orderkey%3 AS VARCHAR) source, strftime(o_orderdate,'%Y-%m-%d') valid_from, o_orderkey seq FROM orders) GROUP BY 1,2,3""")
def mrg3(t):
    return merges.merge_holding(_holding_rows(t))


def _position_rows(t):
    o, k = t.raw("orders"), F.col("o_orderkey")
    return o.select(
        k.alias("id"), (F.col("o_custkey") % 30).alias("entity_id"), F.lpad((F.col("o_custkey") % 3).cast("string"), 6, "0").alias("stock_code"),
        F.col("o_orderpriority").alias("title"), F.when(k % 4 != 0, F.year("o_orderdate").cast("string")).alias("valid_from"), k.alias("seq"))


@query("MRG4", """SELECT id, entity_id, stock_code, title, valid_from, seq FROM (SELECT *, row_number() OVER (PARTITION BY entity_id,stock_code,title,valid_from ORDER BY seq) rn FROM
  (SELECT o_orderkey id, o_custkey%30 entity_id, lpad(CAST(o_custkey%3 AS VARCHAR),6,'0') stock_code, o_orderpriority title,
   CASE WHEN o_orderkey%4<>0 THEN CAST(year(o_orderdate) AS VARCHAR) END valid_from, o_orderkey seq FROM orders)) WHERE rn=1 OR valid_from IS NULL""")
def mrg4(t):
    return merges.dedupe_position(_position_rows(t))


@query("MRG5", f"""SELECT stock_code, entity_id, {', '.join(_KNOWN.format(c=c) for c in ('control_ratio', 'valid_to'))}, min_by(source,seq) source,
  min_by(valid_from,seq) valid_from FROM (SELECT lpad(CAST(o_custkey%9 AS VARCHAR),6,'0') stock_code, o_custkey%40 entity_id,
  CASE WHEN o_orderkey%3=0 THEN CAST(o_orderkey%100 AS DOUBLE) END control_ratio, CASE WHEN o_orderkey%7=0 THEN '2001-01-01' END valid_to,
  's'||CAST(o_orderkey%3 AS VARCHAR) source, strftime(o_orderdate,'%Y-%m-%d') valid_from, o_orderkey seq FROM orders) GROUP BY 1,2""")
def mrg5(t):
    k = F.col("o_orderkey")
    return merges.merge_controller(t.raw("orders").select(
        F.lpad((F.col("o_custkey") % 9).cast("string"), 6, "0").alias("stock_code"), (F.col("o_custkey") % 40).alias("entity_id"),
        F.when(k % 3 == 0, (k % 100).cast("double")).alias("control_ratio"), F.when(k % 7 == 0, "2001-01-01").alias("valid_to"),
        F.concat(F.lit("s"), (k % 3).cast("string")).alias("source"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("valid_from"),
        k.alias("seq")))


_GOLD_KNOWN = ", ".join(_KNOWN.format(c=c) for c in ("party_entity_id", "relation_desc", "source_url", "source_page"))


@query("MRG6", f"""SELECT stock_code, report_year, party_name, {_GOLD_KNOWN} FROM g WHERE report_year IS NOT NULL GROUP BY 1,2,3
  UNION ALL SELECT stock_code, report_year, party_name, party_entity_id, relation_desc, source_url, source_page FROM g WHERE report_year IS NULL""",
       ctes="""g AS (SELECT lpad(CAST(o_custkey%9 AS VARCHAR),6,'0') stock_code, CASE WHEN o_orderkey%6<>0 THEN CAST(year(o_orderdate) AS INTEGER) END report_year,
  o_orderpriority party_name, CASE WHEN o_orderkey%3=0 THEN o_custkey END party_entity_id, CASE WHEN o_orderkey%5=0 THEN o_orderstatus END relation_desc,
  CASE WHEN o_orderkey%7=0 THEN 'u'||CAST(o_orderkey AS VARCHAR) END source_url, CASE WHEN o_orderkey%2=0 THEN CAST(o_orderkey%50 AS INTEGER) END source_page,
  o_orderkey seq FROM orders)""")
def mrg6(t):
    k = F.col("o_orderkey")
    return merges.merge_gold(t.raw("orders").select(
        F.lpad((F.col("o_custkey") % 9).cast("string"), 6, "0").alias("stock_code"), F.when(k % 6 != 0, F.year("o_orderdate")).alias("report_year"),
        F.col("o_orderpriority").alias("party_name"), F.when(k % 3 == 0, F.col("o_custkey")).alias("party_entity_id"),
        F.when(k % 5 == 0, F.col("o_orderstatus")).alias("relation_desc"), F.when(k % 7 == 0, F.concat(F.lit("u"), k.cast("string"))).alias("source_url"),
        F.when(k % 2 == 0, (k % 50).cast("int")).alias("source_page"), k.alias("seq")))


@query("MRG7", """SELECT event_type, subject_code, amount, source_type FROM event
  UNION ALL SELECT 'guarantee', lpad(CAST(o_custkey AS VARCHAR),6,'0'), CASE WHEN o_orderkey%6<>0 THEN CAST(o_orderkey AS DOUBLE) END, 'structured' FROM orders""")
def mrg7(t):
    new = feeds.load_guarantees(_feed(t.raw("orders"), _event_feed("担保笔数", "担保金额")))
    return merges.append_event(t.event, new).select("event_type", "subject_code", "amount", "source_type")


@query("MRG8", """SELECT stock_code, short_name, industry FROM company UNION ALL SELECT subject_code, CASE WHEN s LIKE '%' THEN ltrim(s,'*') END, NULL FROM
  (SELECT subject_code, min('**事'||event_type) s FROM event WHERE subject_code NOT IN (SELECT stock_code FROM company) GROUP BY 1)""")
def mrg8(t):
    facts = t.event.select(F.col("subject_code").alias("stock_code"), F.concat(F.lit("**事"), "event_type").alias("short_name"))
    return merges.backfill_companies(t.company, facts).select("stock_code", "short_name", "industry")


_REKEY = """SELECT o_orderkey id, o_custkey%30 entity_id, CASE o_orderkey%4 WHEN 0 THEN 'SH' WHEN 1 THEN 'BJ' ELSE '' END||lpad(CAST(o_custkey%3 AS VARCHAR),6,'0') stock_code,
  o_orderpriority title, CASE WHEN o_orderkey%4=2 THEN NULL WHEN o_orderkey%8=0 THEN '' ELSE CAST(year(o_orderdate) AS VARCHAR) END valid_from FROM orders"""


@query("MRG9", f"""SELECT id, entity_id, b stock_code, title, valid_from FROM (SELECT *, row_number() OVER (PARTITION BY entity_id,b,title,coalesce(valid_from,'') ORDER BY pre,id) rn FROM
  (SELECT *, substr(stock_code,1,2) IN ('SH','BJ') pre, regexp_replace(stock_code,'^[A-Z]+','') b FROM ({_REKEY}))) WHERE NOT pre OR rn=1""")
def mrg9(t):
    k = F.col("o_orderkey")
    rows = t.raw("orders").select(
        k.alias("id"), (F.col("o_custkey") % 30).alias("entity_id"),
        F.concat(F.when(k % 4 == 0, "SH").when(k % 4 == 1, "BJ").otherwise(""), F.lpad((F.col("o_custkey") % 3).cast("string"), 6, "0")).alias("stock_code"),
        F.col("o_orderpriority").alias("title"),
        F.when(k % 4 == 2, None).when(k % 8 == 0, "").otherwise(F.year("o_orderdate").cast("string")).alias("valid_from"))
    return merges.rekey_positions(rows)


@query("MRG9_company", """SELECT c stock_code, n short_name FROM (SELECT s_name n, CASE WHEN s_suppkey%3=0 THEN 'SZ' ELSE '' END||lpad(CAST(s_suppkey//2 AS VARCHAR),6,'0') c0,
   s_suppkey%3=0 pre, lpad(CAST(s_suppkey//2 AS VARCHAR),6,'0') c, s_suppkey//2 g FROM supplier) x
  WHERE NOT pre OR NOT EXISTS (SELECT 1 FROM supplier y WHERE y.s_suppkey//2=x.g AND y.s_suppkey%3<>0)""")
def mrg9_company(t):
    k = F.col("s_suppkey")
    rows = t.raw("supplier").select(
        F.concat(F.when(k % 3 == 0, "SZ").otherwise(""), F.lpad(F.expr("s_suppkey div 2").cast("string"), 6, "0")).alias("stock_code"),
        F.col("s_name").alias("short_name"))
    return merges.rekey_companies(rows)


@query("MRG10", """SELECT entity_id, n display_name FROM (SELECT entity_id, CASE entity_id%4 WHEN 0 THEN '无' WHEN 1 THEN '不详' ELSE display_name END n FROM entity)
  WHERE n NOT IN ('无','不详') OR entity_id IN (SELECT entity_id FROM position WHERE title_class='director' UNION ALL SELECT entity_id FROM holding WHERE holder_rank=1)""")
def mrg10(t):
    e = t.entity.select("entity_id", F.when(F.col("entity_id") % 4 == 0, "无").when(F.col("entity_id") % 4 == 1, "不详").otherwise(
        F.col("display_name")).alias("display_name"))
    return merges.drop_orphan_entities(e, t.position.where("title_class = 'director'"), t.holding.where("holder_rank = 1"))


# ---- sinks ----
@query("SNK1", """SELECT 'companies' source, CAST(NULL AS VARCHAR) report_period, count(*) n_rows FROM company UNION ALL
  SELECT 'holdings', '20251231', count(*) FROM holding UNION ALL SELECT 'positions', NULL, count(*) FROM position""")
def snk1(t):
    return feeds.ingest_log({"companies": (t.company, None), "holdings": (t.holding, "20251231"), "positions": (t.position, None)})


@query("SNK2", """SELECT 'company' table_name, count(*) n FROM company UNION ALL SELECT 'entity', count(*) FROM entity UNION ALL
  SELECT 'holding', count(*) FROM holding UNION ALL SELECT 'position', count(*) FROM position UNION ALL SELECT 'actual_controller', count(*) FROM controller
  UNION ALL SELECT 'entity_channel', count(*) FROM entity WHERE is_channel=1""")
def snk2(t):
    return feeds.table_counts(t.company, t.entity, t.holding, t.position, t.controller)


@query("SNK3", "SELECT event_id, subject_code FROM event WHERE subject_code NOT IN (SELECT stock_code FROM company)")
def snk3(t):
    return feeds.orphans(t.event, t.company, "subject_code").select("event_id", "subject_code")


query("SNK4", "SELECT stock_code, party_name FROM gold WHERE party_entity_id IS NULL")(lambda t: feeds.unmapped(t.gold))

_PARTY_NAMES = "SELECT c_custkey id, CASE c_custkey%4 WHEN 0 THEN c_name||' 股份有限公司' WHEN 1 THEN ' '||upper(c_name) WHEN 2 THEN c_name||'基金' ELSE '没有' END party_name FROM customer"


@query("LNK3", f"""SELECT p.id, p.party_name, coalesce((SELECT min(entity_id) FROM entity WHERE canonical_name=lower({q.org('p.party_name')})),
   (SELECT min(entity_id) FROM entity WHERE canonical_name=lower({q.norm('p.party_name')}))) entity_id FROM ({_PARTY_NAMES}) p""")
def lnk3(t):
    n = F.col("c_custkey") % 4
    rows = t.raw("customer").select(F.col("c_custkey").alias("id"), F.when(n == 0, F.concat("c_name", F.lit(" 股份有限公司")))
                                    .when(n == 1, F.concat(F.lit(" "), F.upper("c_name"))).when(n == 2, F.concat("c_name", F.lit("基金")))
                                    .otherwise("没有").alias("party_name"))
    return feeds.party_to_entity(rows, t.entity)


@query("CH2", f"SELECT id, CAST({q.channel('name')} OR {q.channel('alt')} AS INTEGER) is_channel FROM (SELECT id, name, CASE WHEN id%5=0 THEN name||'社保' ELSE name END alt FROM holder_name)")
def ch2(t):
    """Channel flag from every spelling of an entity."""
    spellings = F.array("name", F.when(F.col("id") % 5 == 0, F.concat("name", F.lit("社保"))).otherwise(F.col("name")))
    return t.holder_name.select("id", F.exists(spellings, lambda n: names.is_channel_name(n)).cast("int").alias("is_channel"))


_BY_PATTERN = "CASE WHEN " + f"{q.norm('name')} IN {q.in_list([n.replace(' ', '') for n in S.CHANNEL_NAMES])} THEN 'exact' " + " ".join(
    f"WHEN regexp_matches(name, {q.lit(p)}) OR regexp_matches({q.norm('name')}, {q.lit(p)}) THEN {q.lit('pattern:' + p[:30])}"
    for p in S.CHANNEL_PATTERNS) + " ELSE '' END"


@query("CH3", f"SELECT id, {_BY_PATTERN} hit FROM holder_name")
def ch3(t):
    """Which entry of the exclusion list catches a name first."""
    n = names.normalize_name("name")
    hit = F.when(n.isin([x.replace(" ", "") for x in S.CHANNEL_NAMES]), "exact")
    for p in S.CHANNEL_PATTERNS:
        hit = hit.when(F.col("name").rlike(p) | n.rlike(p), "pattern:" + p[:30])
    return t.holder_name.select("id", hit.otherwise("").alias("hit"))
