"""Scalar functions over holder names, codes and documents."""
from pyspark.sql import functions as F

from kinweave import settings as S
from kinweave.catalog import sqlkit as q
from kinweave.catalog.registry import query
from kinweave.functions import codes, names, paths, text


def _names(expr_sql):
    return f"SELECT id, {expr_sql} AS v FROM holder_name"


@query("P1", _names(q.norm("name")))
def p1(t):
    return names.with_normalized(t.holder_name, "name", "v").select("id", "v")


@query("P2", _names(q.org("name")))
def p2(t):
    return t.holder_name.select("id", names.org_match_key("name").alias("v"))


@query("P3", _names(q.manager("name")))
def p3(t):
    return t.holder_name.select("id", names.fund_manager("name").alias("v"))


@query("P4", _names(q.fund_key("name")))
def p4(t):
    return t.holder_name.select("id", names.fund_match_key("name").alias("v"))


@query("P5", _names(f"CAST({q.channel('name')} AS INTEGER)"))
def p5(t):
    return t.holder_name.select("id", names.is_channel_name("name").cast("int").alias("v"))


query("CH1", _names(f"CAST({q.channel('name')} AS INTEGER)").replace("AS v", "AS is_channel"))(
    lambda t: t.holder_name.select("id", names.is_channel_name("name").cast("int").alias("is_channel")))


@query("P6", _names(q.holder_type("holder_type", "name")))
def p6(t):
    return t.holder_name.select("id", names.holder_entity_type("holder_type", "name").alias("v"))


_TITLES = """CASE c_custkey % 9 WHEN 0 THEN '独立 董事' WHEN 1 THEN '监事会主席' WHEN 2 THEN '董事会秘书' WHEN 3 THEN '副总经理'
 WHEN 4 THEN '财务总监' WHEN 5 THEN '职工' WHEN 6 THEN '董秘' WHEN 7 THEN '首席科学家' ELSE '董事长' END"""


@query("P7", f"SELECT id, {q.title('title')} AS v FROM (SELECT c_custkey id, {_TITLES} title FROM customer)")
def p7(t):
    return t.raw("customer").select(F.col("c_custkey").alias("id"), F.expr(_TITLES).alias("title")).select(
        "id", names.title_class("title").alias("v"))


@query("P8", _names(q.controller_type("name")))
def p8(t):
    return t.holder_name.select("id", names.controller_entity_type("name").alias("v"))


@query("P9", f"SELECT id, {q.canonical('ty', 'name')} AS v FROM (SELECT id, name, {q.holder_type('holder_type', 'name')} ty FROM holder_name)")
def p9(t):
    typed = t.holder_name.withColumn("ty", names.holder_entity_type("holder_type", "name"))
    return typed.select("id", names.canonical_for("ty", "name").alias("v"))


_CODES = """CASE o_orderkey % 5 WHEN 0 THEN 'SH' || CAST(o_orderkey AS STRING) WHEN 1 THEN 'sz' || CAST(o_orderkey * 7919 AS STRING)
 WHEN 2 THEN CAST(o_orderkey % 1000 AS STRING) WHEN 3 THEN 'BJ ' || CAST(o_orderkey % 90 AS STRING) ELSE CAST(o_orderkey * 1000003 AS STRING) END"""


@query("P10", "SELECT id, CASE WHEN length(c)<6 THEN lpad(c,6,'0') ELSE c END v FROM "
              f"(SELECT o_orderkey id, trim(regexp_replace({_CODES}, '^[A-Za-z]+', '')) c FROM orders)")
def p10(t):
    return t.raw("orders").select(F.col("o_orderkey").alias("id"), F.expr(_CODES).alias("c")).select(
        "id", codes.strip_code_prefix("c").alias("v"))


_PERIODS = """CASE o_orderkey % 5 WHEN 0 THEN replace(CAST(CAST(o_orderdate AS DATE) AS STRING), '-', '')
 WHEN 1 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) || ' 00:00' WHEN 2 THEN CAST(year(o_orderdate) AS STRING) || 'Q' || CAST(quarter(o_orderdate) AS STRING)
 WHEN 3 THEN CAST(year(o_orderdate) AS STRING) || 'q' || CAST(quarter(o_orderdate) AS STRING) ELSE '年报' END"""


@query("P11", f"""SELECT id, CASE WHEN regexp_full_match(p,'\\d{{8}}') THEN substr(p,1,4)||'-'||substr(p,5,2)||'-'||substr(p,7,2)
  WHEN length(p)>=10 AND substr(p,5,1)='-' AND substr(p,8,1)='-' THEN substr(p,1,10)
  WHEN contains(upper(p),'Q') THEN substr(p,1,4)||'-'||CASE split_part(upper(p),'Q',2) WHEN '1' THEN '03-31' WHEN '2' THEN '06-30'
   WHEN '3' THEN '09-30' ELSE '12-31' END ELSE p END v FROM (SELECT o_orderkey id, {_PERIODS} p FROM orders)""")
def p11(t):
    return t.raw("orders").select(F.col("o_orderkey").alias("id"), F.expr(_PERIODS).alias("p")).select(
        "id", codes.normalize_period("p").alias("v"))


_NUMBERS = "CASE o_orderkey % 4 WHEN 0 THEN 'nan' WHEN 1 THEN '--' ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) END"


@query("P12", f"""SELECT id, CASE WHEN NOT isnan(d) THEN d END f, CASE WHEN NOT isnan(d) THEN CAST(trunc(d) AS INTEGER) END i FROM
  (SELECT o_orderkey id, TRY_CAST({_NUMBERS} AS DOUBLE) d FROM orders)""")
def p12(t):
    return t.raw("orders").select(F.col("o_orderkey").alias("id"), F.expr(_NUMBERS).alias("n")).select(
        "id", codes.safe_double("n").alias("f"), codes.safe_int("n").alias("i"))


@query("P13", "SELECT o_orderkey id, substr(CAST(o_orderdate AS VARCHAR),1,10) v FROM orders")
def p13(t):
    return t.raw("orders").select(F.col("o_orderkey").alias("id"), codes.day_text("o_orderdate").alias("v"))


@query("P14", _names(q.matcher("name")))
def p14(t):
    return t.holder_name.select("id", names.matcher_norm("name").alias("v"))


@query("P15", _names(q.alias("name")))
def p15(t):
    return t.holder_name.select("id", names.derive_alias("name").alias("v"))


@query("P16", _names(q.aligned("name")))
def p16(t):
    return t.holder_name.select("id", names.alignment_name("name").alias("v"))


@query("P17", """SELECT h.id, e.display_name||' -HOLDS'||CASE WHEN ratio IS NULL THEN '' ELSE ' ['||CAST(ratio AS VARCHAR)||'%]' END
  ||'-> '||stock_code||' | '||stock_code||' -SERVED_BY [董事]-> '||e.display_name v FROM holding h JOIN entity e USING (entity_id)""")
def p17(t):
    e = t.entity.select("entity_id", "display_name")
    hops = F.array(paths.make_hop(F.col("display_name"), F.col("stock_code"), "HOLDS", ratio=F.col("ratio"), rank=F.col("holder_rank")),
                   paths.make_hop(F.col("stock_code"), F.col("display_name"), "SERVED_BY", title="董事"))
    return t.holding.join(e, "entity_id").select("id", paths.render_path(hops).alias("v"))


@query("P18", """SELECT id, 'E HOLDS '||stock_code||' '||CASE WHEN ratio IS NULL THEN '' ELSE 'ratio='||CAST(ratio AS VARCHAR)||',' END||'rank='||CAST(holder_rank AS VARCHAR) v FROM holding""")
def p18(t):
    """Hops without their empty attributes."""
    hop = paths.make_hop("E", F.col("stock_code"), "HOLDS", ratio=F.col("ratio"), rank=F.col("holder_rank"))
    attrs = F.array_join(F.transform(F.map_entries(F.col("h.attrs")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return t.holding.select("id", hop.alias("h")).select("id", F.concat_ws(" ", "h.frm", "h.edge", "h.to", attrs).alias("v"))


@query("P19", "SELECT h.id, coalesce(nullif(display_name,''), canonical_name, '') v FROM holding h LEFT JOIN entity USING (entity_id)")
def p19(t):
    e = t.entity.select("entity_id", F.coalesce(F.expr("nullif(display_name, '')"), "canonical_name").alias("n"))
    return t.holding.join(e, "entity_id", "left").select("id", F.coalesce("n", F.lit("")).alias("v"))


@query("P20", r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, 'sk-[a-zA-Z0-9]{10,}', 'sk-***', 'g'),
  'Bearer\s+[a-zA-Z0-9]{10,}', 'Bearer ***', 'g'), 'api[_-]?key[=:]\s*\S+', 'api_key=***', 'gi') v FROM documents""")
def p20(t):
    return t.raw("documents").select("doc_id", text.redact("text").alias("v"))


@query("P21", r"""SELECT doc_id, array_to_string([x for x in regexp_split_to_array(text, '\D+') if length(x)=6], ',') v FROM
  (SELECT doc_id, text FROM documents UNION ALL SELECT -question_id-1, question FROM question)""")
def p21(t):
    both = t.raw("documents").select("doc_id", "text").unionAll(
        t.question.select(-F.col("question_id") - 1, "question"))
    return both.select("doc_id", F.array_join(text.extract_codes("text"), ",").alias("v"))


_TEXTS = "(SELECT statement_id id, text FROM statement UNION ALL SELECT -doc_id-1, text FROM documents)"


def _texts(t):
    return t.statement.select(F.col("statement_id").alias("id"), "text").unionAll(
        t.raw("documents").select(-F.col("doc_id") - 1, "text"))


@query("P22", f"""SELECT id, array_to_string(regexp_extract_all(text, '{S.PERCENT_PATTERN}', 1), ',') percents,
  array_to_string([x[1]||'|'||x[2] for x in list_zip(regexp_extract_all(text, '{S.AMOUNT_PATTERN}', 1),
   regexp_extract_all(text, '{S.AMOUNT_PATTERN}', 2))], ';') amounts, array_to_string(regexp_extract_all(text, '{S.COUNT_PATTERN}', 1), ',') counts FROM {_TEXTS}""")
def p22(t):
    return _texts(t).select("id", F.array_join(text.extract_percents("text"), ",").alias("percents"),
                            F.array_join(text.extract_amounts("text"), ";").alias("amounts"),
                            F.array_join(text.extract_counts("text"), ",").alias("counts"))


@query("P23", f"""SELECT id, array_to_string([y[i]||'-'||lpad(m[i],2,'0')||
  CASE WHEN d[i]<>'' THEN '-'||lpad(d[i],2,'0') ELSE '' END for i in range(1, len(y)+1)], ',') v FROM (SELECT id, regexp_extract_all(text, '{S.DATE_PATTERN}', 1) y,
  regexp_extract_all(text, '{S.DATE_PATTERN}', 2) m, regexp_extract_all(text, '{S.DATE_PATTERN}', 3) d FROM {_TEXTS})""")
def p23(t):
    return _texts(t).select("id", F.array_join(text.extract_dates("text"), ",").alias("v"))


@query("P24", "SELECT doc_id, left(text,200) summary, left(text,500) answer FROM documents")
def p24(t):
    return t.raw("documents").select("doc_id", F.left("text", F.lit(200)).alias("summary"),
                                     F.left("text", F.lit(500)).alias("answer"))


@query("P25", """SELECT id, 'holding#'||CAST(id AS VARCHAR)||' '||source||' '||report_period||' entity_id='||CAST(entity_id AS VARCHAR) v FROM holding""")
def p25(t):
    """Evidence of each holding row."""
    e = paths.make_evidence("holding", F.col("id"), F.col("source"), F.col("report_period"), entity_id=F.col("entity_id"))
    return t.holding.select("id", e.alias("e")).select("id", F.concat(
        "e.table", F.lit("#"), F.col("e.pk").cast("string"), F.lit(" "), "e.source", F.lit(" "), "e.report_period",
        F.lit(" entity_id="), F.col("e.raw")["entity_id"]).alias("v"))


@query("P26", """SELECT s_suppkey id, CASE WHEN starts_with(c,'60') OR starts_with(c,'68') OR starts_with(c,'9') THEN 'sh' ELSE 'sz' END||c v
  FROM (SELECT s_suppkey, lpad(CAST(s_suppkey*60007%1000000 AS VARCHAR),6,'0') c FROM supplier)""")
def p26(t):
    return t.raw("supplier").select(F.col("s_suppkey").alias("id"), codes.exchange_code(
        F.col("s_suppkey") * 60007 % 1000000).alias("v"))
