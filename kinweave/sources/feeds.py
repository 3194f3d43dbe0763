"""Feeds as they arrive, with their own column headers, to typed facts. All of it is projection plus one or two joins."""
from pyspark.sql import DataFrame, functions as F

from kinweave import settings as S
from kinweave.functions import codes, names
from kinweave.sources import merges


def normalized_headers(df: DataFrame) -> DataFrame:
    """Headers without blanks and width variants, so that drifting feeds still select."""
    import re
    import unicodedata
    return df.toDF(*[re.sub(r"\s+", "", unicodedata.normalize("NFKC", c)) for c in df.columns])


def _given(c):
    return F.coalesce((F.col(c) != "") & (F.lower(F.col(c)) != "nan"), F.lit(False))


def load_companies(df):
    return df.select(codes.pad_code("code").alias("stock_code"), F.col("name").cast("string").alias("short_name"))


def load_holdings(df):
    """Top-holder snapshot: no ratio, rank from the feed."""
    n = F.col("n")
    df = (normalized_headers(df).withColumn("n", names.normalize_name("股东名称"))
          .withColumn("t", names.normalize_name("股东类型"))
          .withColumn("entity_type", names.holder_type_of_normalized(F.col("t"), n))
          .withColumn("channel", names.is_channel_name("股东名称", normalized=n)))
    return df.select(
        codes.pad_code("股票代码").alias("stock_code"), F.ltrim(F.col("股票简称")).alias("company_name"), "entity_type",
        names.canonical_of_normalized("entity_type", n).alias("canonical_name"), F.col("股东名称").alias("display_name"),
        F.col("channel").cast("int").alias("is_channel"), F.when(F.col("channel"), "medium").otherwise("high").alias("confidence"),
        codes.day_text("报告期").alias("report_period"), codes.safe_double("期末持股-数量").alias("shares"),
        F.lit(None).cast("double").alias("ratio"), codes.safe_int("序号").alias("holder_rank"),
        F.lit(S.BATCH_SOURCE).alias("source"), codes.day_text("报告期").alias("valid_from"))


def load_exec_changes(df):
    """Executive share changes: a person, with ratio, without rank."""
    df = normalized_headers(df).where(_given("股东名称"))
    period = F.coalesce(F.expr("nullif(`变动截止日`, '')"), F.expr("nullif(`公告日`, '')"), F.lit(""))
    return df.select(
        codes.pad_code("代码").alias("stock_code"), F.col("名称").alias("company_name"), F.lit("person").alias("entity_type"),
        names.normalize_name("股东名称").alias("canonical_name"), F.col("股东名称").alias("display_name"),
        F.lit(0).alias("is_channel"), F.lit("medium").alias("confidence"), F.substring(period, 1, 10).alias("report_period"),
        codes.safe_double("变动后持股情况-持股总数").alias("shares"), codes.safe_double("变动后持股情况-占总股本比例").alias("ratio"),
        F.lit(None).cast("int").alias("holder_rank"), F.lit(S.CHANGE_SOURCE).alias("source"),
        F.substring(F.coalesce("变动开始日", F.lit("")), 1, 10).alias("valid_from"))


def load_positions(df, company):
    """Positions, one row per feed row; a missing code is looked up by normalised company name.

    Returns (rows for entities, rows for positions): rows without a title create the entity only.
    """
    df = normalized_headers(df)
    by_name = company.groupBy(names.normalize_name("short_name").alias("n")).agg(F.max("stock_code").alias("found"))
    code = F.trim(F.coalesce(F.col("股票代码").cast("string"), F.lit("")))
    rows = (df.withColumn("given", F.when((code != "") & (code != "nan"), code))
            .withColumn("n", names.normalize_name("股票名称")).join(by_name, "n", "left")
            .withColumn("code", F.coalesce("given", "found")).where("code IS NOT NULL AND code <> ''"))
    out = rows.select(
        codes.strip_code_prefix("code").alias("stock_code"), F.col("股票名称").alias("company_name"),
        F.lit("person").alias("entity_type"), names.normalize_name("变动人").alias("canonical_name"),
        F.col("变动人").alias("display_name"), F.lit(0).alias("is_channel"), F.lit("low").alias("confidence"),
        F.coalesce("董监高职务", F.lit("")).alias("title"), names.title_class("董监高职务").alias("title_class"),
        F.lit(S.POSITION_SOURCE).alias("source"), F.substring(F.coalesce("变动日期", F.lit("")), 1, 10).alias("valid_from"))
    return out.drop("title", "title_class", "valid_from"), out.where("title <> '' AND title <> 'nan'")


def load_controllers(df):
    """Controllers: first name of the chain; rows that only say 'none' or 'unknown' are no controllers."""
    df = normalized_headers(df)
    chain = F.filter(F.transform(F.split(F.coalesce("实际控制人名称", F.lit("")), r"[\r\n;]+"), lambda x: F.trim(x)), lambda x: x != "")
    rows = (df.withColumn("chain", chain).withColumn("name", F.try_element_at("chain", F.lit(1)))
            .where(F.col("name").isNotNull() & ~F.col("name").isin(S.PLACEHOLDER_CONTROLLERS))
            .withColumn("n", names.normalize_name("name"))
            .withColumn("entity_type", names.controller_type_of_normalized(F.col("n"))))
    return rows.select(
        codes.pad_code("证券代码").alias("stock_code"), F.col("证券简称").alias("company_name"), "entity_type",
        names.canonical_of_normalized("entity_type", F.col("n")).alias("canonical_name"), F.col("name").alias("display_name"),
        F.lit("high").alias("confidence"),
        F.concat(F.lit("控制类型="), F.coalesce("控制类型", F.lit("None")), F.lit("; chain_tokens="),
                 F.size("chain").cast("string")).alias("disambig_note"),
        codes.safe_double("控股比例").alias("control_ratio"), F.lit(S.CONTROLLER_SOURCE).alias("source"),
        F.substring(F.coalesce("变动日期", F.lit("")), 1, 10).alias("valid_from")).where("stock_code <> '000nan' AND stock_code <> ''")


def _aggregate_events(df, kind, count_header, amount_header, unit):
    df = normalized_headers(df)
    return df.select(
        F.lit(kind).alias("event_type"), codes.pad_code("证券代码").alias("subject_code"),
        codes.safe_double(amount_header).alias("amount"),
        F.concat(F.col(count_header).cast("string"), F.lit(unit)).alias("summary"),
        F.col("公告统计区间").cast("string").alias("event_date"), F.lit("structured").alias("source_type"))


def load_guarantees(df):
    return _aggregate_events(df, "guarantee", "担保笔数", "担保金额", "笔")


def load_lawsuits(df):
    return _aggregate_events(df, "lawsuit", "诉讼次数", "诉讼金额", "次")


def party_to_entity(parties: DataFrame, entity: DataFrame, name="party_name", out="entity_id") -> DataFrame:
    """First key of a name that is some entity's canonical name: fund key, organisation key, normalised, as written.

    Only the distinct names are expanded into keys; the dimension is matched by hash join on the key.
    """
    raw = F.trim(name)
    keys = F.filter(F.array(
        F.when(names.contains_any(raw, ["基金", "资管", "计划"]), names.fund_match_key(raw)),
        names.org_match_key(raw), names.normalize_name(raw), raw), lambda k: k.isNotNull() & (k != ""))
    wanted = parties.select(name).distinct().select(name, F.posexplode(keys).alias("priority", "k")).select(
        name, "priority", F.lower("k").alias("k"))
    known = entity.groupBy(F.lower("canonical_name").alias("k")).agg(F.min("entity_id").alias("found"))
    best = wanted.join(known, "k").groupBy(name).agg(F.min_by("found", "priority").alias(out))
    return parties.join(best, name, "left")


def load_pledges(df, entity):
    df = normalized_headers(df)
    a, b = F.coalesce("出质人", F.lit("")), F.coalesce("质权人", F.lit(""))
    rows = df.select(
        F.lit("pledge").alias("event_type"), codes.pad_code("股票代码").alias("subject_code"), a.alias("pledgor"),
        F.when((a != "") | (b != ""), F.concat(a, F.lit(" -> "), b)).alias("counterparty"),
        codes.safe_double("质押数量").alias("amount"), F.col("质押事项").cast("string").alias("summary"),
        F.col("公告日期").cast("string").alias("event_date"), F.lit("structured").alias("source_type"))
    return party_to_entity(rows, entity, "pledgor", "counterparty_entity_id").drop("pledgor")


def ingest_log(frames: dict) -> DataFrame:
    """Rows per feed. frames: source -> (DataFrame, report period or None)."""
    out = None
    for source, (df, period) in frames.items():
        one = df.groupBy().agg(F.lit(source).alias("source"), F.lit(period).cast("string").alias("report_period"),
                               F.count("*").alias("n_rows"))
        out = one if out is None else out.unionAll(one)
    return out


def table_counts(company, entity, holding, position, controller) -> DataFrame:
    frames = {"company": company, "entity": entity, "holding": holding, "position": position,
              "actual_controller": controller, "entity_channel": entity.where("is_channel = 1")}
    out = None
    for name, df in frames.items():
        one = df.groupBy().agg(F.lit(name).alias("table_name"), F.count("*").alias("n"))
        out = one if out is None else out.unionAll(one)
    return out


def orphans(fact, company, code="stock_code"):
    """Facts whose company is missing."""
    return fact.join(company.select(F.col("stock_code").alias(code)), code, "left_anti")


def unmapped(gold):
    return gold.where("party_entity_id IS NULL").select("stock_code", "party_name")


def write_unmapped(gold, path):
    unmapped(gold).write.mode("overwrite").option("header", True).csv(path)


backfill_companies = merges.backfill_companies
