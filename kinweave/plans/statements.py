"""Free text checked against the tables, and parties found in the text of reports."""
import re

from pyspark.sql import DataFrame, functions as F

from kinweave import settings as S
from kinweave.functions import names, text as tx
from kinweave.functions.codes import day_text, safe_double
from kinweave.plans import linking


def suspected_names(c):
    """Names that look like companies: a suffix with up to 20 characters before it, back to a stop word or a break."""
    c = F.col(c) if isinstance(c, str) else c
    single = "".join(w for w in S.MENTION_STOP_WORDS if len(w) == 1)
    run = f"([^{single}{S.MENTION_BREAK}]*)$"
    none = F.array().cast("array<string>")

    def of(suffix):
        parts = F.split(c, re.escape(suffix), -1)

        def one(k):
            before = F.right(F.array_join(F.slice(parts, F.lit(1), k), suffix), F.lit(20))
            head = F.regexp_extract(before, run, 1)
            for pair in (w for w in S.MENTION_STOP_WORDS if len(w) == 2):
                head = F.regexp_replace(head, f"^.*{pair[0]}(?={pair[1]})", "")
            return F.trim(F.concat(head, F.lit(suffix)))

        return F.when(c.contains(suffix), F.transform(F.sequence(F.lit(1), F.size(parts) - 1), one)).otherwise(none)

    found = [of(suffix) for suffix in S.MENTION_SUFFIXES]
    return F.filter(F.array_distinct(F.concat(*found)), lambda x: (F.char_length(x) >= 4) & ~names.normalize_name(x).isin(S.MENTION_GENERIC))


def mentions(statements, key="id", text="text") -> DataFrame:
    return tx.exploded(statements, [key], suspected_names(text), "mention")


def values(statements, key="id", text="text") -> DataFrame:
    """Numbers of a statement as rows: key, kind, value."""
    return tx.exploded(statements, [key], tx.values_of(text), "v").select(key, "v.kind", "v.value")


def wrong_values(stated, allowed, key="id") -> DataFrame:
    """Stated values no allowed value of the same statement comes near: percent within 0.1, amount within 0.01, rest exact.

    stated: key, kind, value (text). allowed: key, kind, number (double) for percent and amount, value (text) for the rest.
    """
    number = F.when(F.col("kind") == "percent", F.col("value").cast("double")).when(
        F.col("kind") == "amount", F.split("value", r"\|")[0].try_cast("double"))
    rows = stated.withColumn("stated_number", number)
    other = allowed.select(F.col(key).alias("_k"), F.col("kind").alias("_kind"), F.col("number").alias("_number"), F.col("value").alias("_value"))
    tolerance = F.when(F.col("kind") == "percent", 0.1).otherwise(0.01)
    near = F.when(F.col("kind").isin("percent", "amount"), F.abs(F.col("stated_number") - F.col("_number")) < tolerance).otherwise(
        F.when(F.col("kind") == "count", F.col("value").cast("bigint") == F.col("_value").cast("bigint")).otherwise(F.col("value") == F.col("_value")))
    return rows.join(other, (F.col(key) == F.col("_k")) & (F.col("kind") == F.col("_kind")) & near, "left_anti").select(key, "kind", "value")


def result_values(holders, controllers, events, key="stock_code") -> DataFrame:
    """Values a structured result vouches for. holders: key, ratio; controllers: key, control_ratio; events: key, amount, event_date.

    Every number of the result also counts as a possible count.
    """
    def rows(df, kind, number, value=None):
        return df.where(number.isNotNull() if value is None else value.isNotNull()).select(
            key, F.lit(kind).alias("kind"), number.cast("double").alias("number"), (F.lit(None) if value is None else value).cast("string").alias("value"))
    none = F.lit(None)
    out = rows(holders, "percent", F.col("ratio")).unionAll(rows(controllers, "percent", F.col("control_ratio")))
    out = out.unionAll(rows(events, "amount", F.col("amount"))).unionAll(rows(events, "date", none, F.col("event_date")))
    for df in (holders, events):
        out = out.unionAll(rows(df.groupBy(key).agg(F.count("*").alias("n")), "count", none, F.col("n")))
    for df, c in ((holders, "ratio"), (controllers, "control_ratio"), (events, "amount")):
        out = out.unionAll(rows(df, "count", none, F.col(c).cast("bigint")))
    return out.distinct()


def unknown_companies(statements, company, entity, key="id", text="text", result_names=None) -> DataFrame:
    """Suspected names that are no known name, contain none and are in none, and match no entity.

    result_names (key, name): names of the structured result a statement was made from; they count as known for it.
    """
    found = mentions(statements, key, text)
    n = names.normalize_name("mention")
    cand = found.select("mention").distinct().withColumn("cn", n)
    known = linking.company_dictionary(company).select("word").unionAll(linking.person_dictionary(entity).select("word")).distinct()
    probes = cand.select(F.lower("cn").alias("id"), F.lower("cn").alias("text")).distinct()
    long_known = known.where("char_length(word) >= 3")
    holds_known = linking.occurrences(probes, long_known).select(F.col("id").alias("k"))
    in_known = linking.occurrences(long_known.select(F.col("word").alias("id"), F.col("word").alias("text")),
                                   probes.select(F.col("text").alias("word"))).select(F.col("word").alias("k"))
    exact = known.select(F.col("word").alias("k"))
    keys = cand.select(F.lower("cn").alias("k"), F.explode(F.array(F.col("cn"), names.org_key_of_normalized(F.col("cn")))).alias("c"))
    canon = keys.withColumn("c", F.lower("c")).join(entity.select(F.lower("canonical_name").alias("c")).distinct(), "c", "left_semi").select("k")
    shown = entity.where("is_channel = 0").select(F.lower("display_name").alias("text")).distinct().withColumn("id", F.col("text"))
    within = linking.occurrences(shown, probes.where("char_length(text) >= 6").select(F.col("text").alias("word"))).select(F.col("word").alias("k"))
    fine = exact.unionAll(holds_known).unionAll(in_known).unionAll(canon).unionAll(within).distinct()
    bad = cand.withColumn("k", F.lower("cn")).join(fine, "k", "left_anti").select("mention")
    out = found.join(bad, "mention", "left_semi").select(key, "mention")
    if result_names is None:
        return out
    given = result_names.select(F.col(key).alias("_k"), names.normalize_name("name").alias("_n")).where("_n <> ''").distinct()
    cn, k = names.normalize_name("mention"), F.col("_n")
    vouched = (cn == k) | ((F.char_length(k) >= 3) & (cn.contains(k) | k.contains(cn)))
    return out.join(given, (F.col(key) == F.col("_k")) & vouched, "left_anti")


def unknown_codes(statements, company, key="id", text="text") -> DataFrame:
    stated = tx.exploded(statements, [key], tx.extract_codes(text), "stock_code")
    return stated.join(company.select("stock_code"), "stock_code", "left_anti").select(key, "stock_code")


def wording(statements, key="id", text="text") -> DataFrame:
    return tx.exploded(statements, [key], tx.wording_hits(text), "v").select(key, "v.kind", "v.value")


def verdicts(statements, company, entity, allowed=None, key="id", text="text", result_names=None) -> DataFrame:
    """Per statement: number of violations, of wording hits, and whether it passes."""
    bad = unknown_companies(statements, company, entity, key, text, result_names).select(key).unionAll(
        unknown_codes(statements, company, key, text).select(key))
    if allowed is not None:
        bad = bad.unionAll(wrong_values(values(statements, key, text), allowed, key).select(key))
    tagged = bad.select(key, F.lit(1).alias("v"), F.lit(0).alias("e")).unionAll(
        wording(statements, key, text).select(key, F.lit(0), F.lit(1)))
    n = tagged.groupBy(key).agg(F.sum("v").alias("violations"), F.sum("e").alias("wording"))
    return statements.select(key).join(n, key, "left").na.fill(0, ["violations", "wording"]).withColumn(
        "passed", ((F.col("violations") == 0) & (F.col("wording") == 0)).cast("int"))


def in_text(name, text):
    """A name occurs in its text, as written or normalised."""
    return text.contains(name) | names.normalize_name(text).contains(names.normalize_name(name))


def extracted_events(rows) -> DataFrame:
    """Extracted events kept where the other party is in the text: known types, numbers, cut summaries.

    rows: id, text, event_type, counterparty, amount, summary, event_date (all text).
    """
    cp = F.trim(F.coalesce("counterparty", F.lit("")))
    ok = rows.where((cp == "") | in_text(cp, F.col("text")))
    kind = F.when(F.col("event_type").isin(S.EXTRACTED_EVENT_TYPES), F.col("event_type")).otherwise("other")
    return ok.select("id", kind.alias("event_type"), F.expr("nullif(trim(counterparty), '')").alias("counterparty"),
                     safe_double("amount").alias("amount"), F.left(F.coalesce("summary", F.lit("")), F.lit(200)).alias("summary"),
                     F.expr("nullif(substring(event_date, 1, 10), '')").alias("event_date"), F.lit("llm_extracted").alias("source_type"))


# ---- report text ----
def organisations(texts, key="id", text="text") -> DataFrame:
    return tx.exploded(texts, [key], tx.organisation_names(text), "name")


def first_page(pages, wanted, key="doc_id") -> DataFrame:
    """First page (1-based) holding a name, in normalised spelling first. pages: key, page (0-based), text. wanted: key, name."""
    n = names.normalize_name("name")
    both = wanted.withColumn("n", n).join(pages, key)
    norm = F.when((F.col("n") != "") & names.normalize_name("text").contains(F.col("n")), F.col("page"))
    raw = F.when(F.col("text").contains(F.col("name")), F.col("page"))
    return both.groupBy(key, "name").agg(F.min(norm).alias("a"), F.min(raw).alias("b")).select(
        key, "name", (F.coalesce("a", "b") + 1).alias("page"))


def locate_section(lines, n_pages, key="doc_id", skip=20, last=None, span=20, scatter=None) -> DataFrame:
    """Pages of the section on related parties: header line, end at the next boundary; else pages that mention it.

    lines: key, page (0-based), line. n_pages: key, n_pages. Every step is a minimum per document. last and scatter bound the pages read and the
    pages of mention; without them all count.
    """
    t = F.trim("line")
    body = lines.join(n_pages, key).where((F.col("page") >= skip) & (F.col("page") < (F.least(F.col("n_pages"), F.lit(last)) if last else F.col("n_pages"))))
    header = body.where((F.char_length(t) < 40) & names.contains_any(t, S.SECTION_HEADERS)).groupBy(key).agg(F.min("page").alias("start"))
    stops = body.where((F.char_length(t) < 30) & t.rlike(S.SECTION_BOUNDARY)).join(header, key).where(
        (F.col("page") > F.col("start")) & (F.col("page") <= F.col("start") + span)).groupBy(key).agg(F.min("page").alias("stop"))
    by_header = header.join(stops, key, "left").join(n_pages, key).select(
        key, "start", F.coalesce("stop", F.least(F.col("start") + span, F.col("n_pages"))).alias("end"), F.lit("regex").alias("method"))
    spots = body.where(names.contains_any(F.col("line"), ["关联方", "关联交易"])).select(key, "page").distinct().join(header, key, "left_anti")
    from kinweave.operators.summaries import first_per_key
    some = (first_per_key(spots, [key], ["page"], scatter) if scatter else spots).groupBy(key).agg(F.min("page").alias("start"), (F.max("page") + 1).alias("end"))
    out = by_header.unionAll(some.select(key, "start", "end", F.lit("scatter")))
    return n_pages.select(key).join(out, key, "left").withColumn("method", F.coalesce("method", F.lit("none")))


def party_rows(cells, keys=("doc_id", "page", "tbl")) -> DataFrame:
    """Parties listed in tables whose header names them. cells: keys, row (0 = header), col, text."""
    t = F.trim(F.coalesce("text", F.lit("")))
    head = cells.where("row = 0").withColumn("t", t)
    name_col = head.where(F.col("t").contains("关联方") & ~F.col("t").rlike("金额|比例|余额|日期|占")).groupBy(*keys).agg(F.min("col").alias("name_col"))
    rel_col = head.where(F.col("t").rlike("关系|性质")).groupBy(*keys).agg(F.min("col").alias("rel_col"))
    shape = name_col.join(rel_col, list(keys), "left")
    body = cells.where("row > 0").withColumn("t", t).join(shape, list(keys)).where("col = name_col OR col = rel_col")
    rows = body.groupBy(*keys, "row").agg(F.max(F.when(F.col("col") == F.col("name_col"), F.col("t"))).alias("party_name"),
                                          F.max(F.when(F.col("col") == F.col("rel_col"), F.col("t"))).alias("relation_desc"))
    return rows.where((F.char_length("party_name") >= 2) & ~F.col("party_name").isin(S.TABLE_STOP_ROWS)).withColumn(
        "relation_desc", F.coalesce("relation_desc", F.lit("")))


def annual_reports(announcements) -> DataFrame:
    """Annual reports among announcements, newest first per company, with the address of the file.

    announcements: stock_code, title, time, url.
    """
    from pyspark.sql import Window
    t = F.trim("title")
    keep = announcements.where(t.endswith("年度报告") & ~t.rlike("半年度|摘要|英文|更正|修订|补丁|H股"))
    order = Window.partitionBy("stock_code").orderBy(F.desc("time"), "url")
    doc, day = F.regexp_extract("url", r"announcementId=(\d+)", 1), day_text(F.coalesce("time", F.lit("")))
    pdf = F.when((doc != "") & (day != ""), F.concat(F.lit("http://static.cninfo.com.cn/finalpage/"), day, F.lit("/"), doc, F.lit(".PDF")))
    return keep.select("stock_code", t.alias("title"), "time", pdf.alias("pdf_url"), F.row_number().over(order).alias("newest"))
