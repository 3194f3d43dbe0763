"""Joins, aggregations, rankings and set operations over the facts."""
from pyspark.sql import DataFrame, Window, functions as F

from kinweave import settings as S
from kinweave.session import written


# ---- joins ----
def named_facts(fact, entity, company):
    """Facts with the entity's and the company's name; an unknown company shows its code."""
    return (fact.join(entity.select("entity_id", "display_name"), "entity_id")
            .join(company.select("stock_code", "short_name"), "stock_code", "left")
            .withColumn("short_name", F.coalesce("short_name", "stock_code")))


def entity_to_company(entity, company):
    """The listed company an entity is, by its display name; at most one."""
    by_name = company.groupBy(F.col("short_name").alias("display_name")).agg(F.min("stock_code").alias("listed_code"))
    return entity.join(by_name, "display_name").select("entity_id", "display_name", "listed_code")


def ratio_by_name(holding, entity):
    """Largest ratio per company and holder name, over all entities of that name."""
    return holding.where("ratio IS NOT NULL").join(entity.select("entity_id", "display_name"), "entity_id").groupBy(
        "stock_code", "display_name").agg(F.max("ratio").alias("ratio"))


def homonyms(entity, name="name", key="id"):
    """Entities that share a name, each paired with the first of its name."""
    first = entity.groupBy(name).agg(F.min(key).alias("first_id"), F.count("*").alias("n")).where("n > 1")
    return entity.join(first, name).where(F.col(key) != F.col("first_id")).select(
        name, "first_id", F.col(key).alias("other_id"))


def prefix_match(names, entity, holding):
    """For every given name (column `name`) the non-channel entity starting with it that has most holdings."""
    n_hold = holding.groupBy("entity_id").agg(F.count("*").alias("hold_count"))
    sizes = names.agg(F.array_sort(F.collect_set(F.char_length("name"))).alias("ks"))
    live = entity.where("is_channel = 0").join(n_hold, "entity_id").select(
        "entity_id", "display_name", "hold_count", sizes.scalar().alias("ks"))
    heads = live.select("entity_id", "display_name", "hold_count", F.explode("ks").alias("k")).where(
        "k <= char_length(display_name)")
    heads = heads.withColumn("name", F.expr("left(display_name, k)"))
    return heads.join(names.select("name").distinct(), "name").groupBy("name").agg(
        F.max_by(F.struct("entity_id", "display_name", "hold_count"), F.struct("hold_count", -F.col("entity_id"))).alias("m")).select(
        "name", "m.entity_id", "m.display_name", "m.hold_count")


# ---- aggregations ----
def holder_maxima(holding, entity):
    live = entity.where("is_channel = 0").select("entity_id", "entity_type", "confidence")
    per = holding.groupBy("stock_code", "entity_id").agg(
        *[F.max(c).alias(c) for c in ("ratio", "id", "holder_rank", "report_period", "source")])
    return per.join(live, "entity_id")


def holders_by_name(holding, entity, sources=None, with_channels=True):
    """Largest ratio and first row per company and holder name."""
    rows = holding if sources is None else holding.where(F.col("source").isin(sources))
    e = entity if with_channels else entity.where("is_channel = 0")
    return rows.join(e.select("entity_id", "display_name", "entity_type", "is_channel"), "entity_id").groupBy(
        "stock_code", "display_name", "entity_type", "is_channel").agg(F.max("ratio").alias("ratio"), F.min("id").alias("first_id"))


def person_records(position, holding, entity):
    """Positions plus holdings per non-channel person."""
    people = entity.where("entity_type = 'person' AND is_channel = 0").select("entity_id", "canonical_name", "display_name")
    rows = position.groupBy("entity_id").agg(F.count("*").alias("n")).unionAll(
        holding.groupBy("entity_id").agg(F.count("*").alias("n")))
    return rows.groupBy("entity_id").agg(F.sum("n").alias("n_records")).join(people, "entity_id")


def company_counts(position, holding):
    """Different companies per entity over positions and holdings."""
    codes = position.select("entity_id", "stock_code").unionAll(holding.select("entity_id", "stock_code")).distinct()
    return codes.groupBy("entity_id").agg(F.count("*").alias("n_companies"))


def event_totals(event, keys=("event_type",)):
    """Count and amount per type; unknown amounts count as nothing."""
    return event.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(
        F.coalesce("amount", F.lit(0.0)).cast("decimal(18,2)")).cast("decimal(28,2)").alias("total_amount"))


def event_sources(event):
    """Events by type and source, with totals per type and overall."""
    return event.groupingSets([[F.col("event_type"), F.col("source_type")], [F.col("event_type")], []],
                              "event_type", "source_type").agg(
        F.count("*").alias("n"), F.count_distinct("subject_code").alias("n_companies"))


def gold_counts(gold_scoped):
    return gold_scoped.groupBy("stock_code").agg(
        F.count("*").alias("gold_count"), F.count_if(F.col("scope_class") == "upstream").alias("upstream_count"),
        F.count_if(F.col("scope_class") == "downstream").alias("downstream_count"),
        F.count("party_entity_id").alias("mapped_count"))


def scope_shares(gold_scoped):
    per = gold_scoped.groupBy("scope_class").agg(F.count("*").alias("n"), F.count("party_entity_id").alias("n_mapped"))
    return per.withColumn("share_bp", F.expr("n * 10000 div sum(n) over ()")).withColumn(
        "mapped_bp", F.expr("n_mapped * 10000 div n"))


def controllers_by_companies(controller, entity):
    return controller.groupBy("entity_id").agg(F.count_distinct("stock_code").alias("n_companies")).join(
        entity.select("entity_id", "display_name"), "entity_id")


def companies_per_table(**tables):
    out = None
    for name, df in tables.items():
        one = df.groupBy().agg(F.lit(name).alias("table_name"), F.count_distinct("stock_code").alias("n_companies"))
        out = one if out is None else out.unionAll(one)
    return out


def coverage(company, holding, entity, position, controller):
    """One line of coverage figures over the whole market."""
    h = holding.join(entity.select("entity_id", "is_channel"), "entity_id")
    figures = {
        "n_companies": company.groupBy().agg(F.count("*").alias("v")),
        "holding_companies": h.groupBy().agg(F.count_distinct("stock_code").alias("v")),
        "non_channel_rows": h.groupBy().agg(F.count_if(F.col("is_channel") == 0).alias("v")),
        "channel_share_bp": h.groupBy().agg((F.sum("is_channel") * 10000 / F.count("*")).cast("bigint").alias("v")),
        "non_channel_per_company_milli": h.where("is_channel = 0").groupBy("stock_code").agg(F.count("*").alias("n")).groupBy().agg(
            (F.sum("n") * 1000 / F.count("*")).cast("bigint").alias("v")),
        "people": position.groupBy().agg(F.count_distinct("entity_id").alias("v")),
        "people_in_two_companies": position.select("entity_id", "stock_code").distinct().groupBy("entity_id").agg(
            F.count("*").alias("n")).groupBy().agg(F.count_if(F.col("n") >= 2).alias("v")),
        "controlled_companies": controller.groupBy().agg(F.count_distinct("stock_code").alias("v")),
    }
    out = None
    for name, df in figures.items():
        one = df.select(F.lit(name).alias("figure"), F.col("v").cast("bigint").alias("value"))
        out = one if out is None else out.unionAll(one)
    return out


def top(df, n, *order):
    """The first n rows of a report."""
    return df.orderBy(*order).limit(n)


#: Pieces of a range of values that are counted in place of a sort, and how many different values one task may order.
RANK_PIECES, RANK_LAST = 1024, 65_536
#: A level for sign and exponent and six for the 52 bits of a fraction; 2^11 whole numbers at most share a double.
RANK_LEVELS = 7


def _exponent_piece(v):
    """Sign and power of two of a number, in its order; the logarithm never falls where its argument grows."""
    size = F.floor(F.greatest(F.lit(-1075.0), F.least(F.lit(1024.0), F.log2(F.abs(v))))) + 1076
    return F.when(F.isnan(v), F.lit(2101)).when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0)).cast("bigint")


def _even_piece(v, lo, hi):
    width = hi - lo
    return F.when(width > 0, F.least(F.lit(RANK_PIECES - 1), F.floor((v - lo) / width * RANK_PIECES))).otherwise(F.lit(0)).cast("bigint")


def nearest_rank(df, keys, value, percents=(50, 95), last=RANK_LAST):
    """Nearest-rank percentiles: the element at index int(n * p / 100), clamped, of the sorted values.

    Few keys may hold all rows, so no key is sorted. Values are counted first. Where a key has more than `last` different ones, they are
    cut into pieces that keep their order, and the counts of the pieces say which one holds the rank: by sign and exponent first, so that
    no outlier decides how the others are cut, then into equal parts between the ends of the piece, until no piece asked for has more than
    `last` different values (six times settle every bit of a fraction). Only the values of that piece are ordered. The result is exact for
    every distribution. NaN counts as the largest value; null values and rows with a null key are left out.
    """
    keys = list(keys)
    at = [*keys, "_p"]
    counted = written(df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c")), "rank-counts")
    total = counted.groupBy(*keys).agg(
        F.sum("_c").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_different"))
    asked = written(total.select("*", F.explode(F.array(*map(F.lit, percents))).alias("_p")).withColumn(
        "_at", F.least(F.floor(F.col("n") * F.col("_p") / 100), F.col("n") - 1)), "rank-asked")
    v, lo, hi = (F.col(c).cast("double") for c in ("_v", "_lo", "_hi"))
    inside = F.col("_v").between(F.col("_lo"), F.col("_hi"))
    for level in range(RANK_LEVELS):
        if (asked.agg(F.max("_different")).first()[0] or 0) <= last:
            break
        piece = _even_piece(v, lo, hi) if level else _exponent_piece(v)
        sums = counted.join(asked.drop("_different"), keys).where(inside).groupBy(*at, "n", "_at", piece.alias("_piece")).agg(
            F.sum("_c").alias("_sum"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_different"))
        before = F.coalesce(F.sum("_sum").over(Window.partitionBy(*at).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        asked = written(sums.withColumn("_before", before).where((F.col("_before") <= F.col("_at")) & (F.col("_at") < F.col("_before") + F.col("_sum"))).select(
            *at, "n", "_lo", "_hi", "_different", (F.col("_at") - F.col("_before")).alias("_at")), "rank-asked")
    left = counted.join(asked.drop("_different"), keys).where(inside)
    upto = F.sum("_c").over(Window.partitionBy(*at).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    found = left.withColumn("_upto", upto).where(F.col("_upto") > F.col("_at"))
    return found.groupBy(*keys).agg(F.max("n").alias("n"), *[F.min(F.when(F.col("_p") == p, F.col("_v"))).alias(f"p{p}") for p in percents])


# ---- rankings ----
def first_per_key(df, keys, order, n, rank="rank"):
    """First n rows per key with their rank; the limit is pushed below the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def top_holders(holding, entity, n=10, **kw):
    return first_per_key(holders_by_name(holding, entity, **kw), ["stock_code"], ["first_id", "display_name", "entity_type"], n)


def reverse_holdings(holding):
    """Companies of every holder by largest ratio, unknown ratios last."""
    w = Window.partitionBy("entity_id").orderBy(F.desc_nulls_last("ratio"), "stock_code")
    return holding.groupBy("entity_id", "stock_code").agg(F.max("ratio").alias("ratio")).withColumn(
        "rank", F.row_number().over(w).cast("bigint"))


#: Values of a key that one task numbers together.
COUNT_PIECE = 4096


def running_count(df, keys, value, name, piece=COUNT_PIECE):
    """Add the number of each row among the rows of its key in the order of a whole-number column (ties in no order), from 1.

    A key may hold most rows, so none is ordered as a whole. The range of a key's values is cut into as many equal pieces as its rows ask for;
    the counts of the pieces say what lies before each, and only the rows of one piece are ordered. Values that crowd in a few
    pieces leave those larger; ids handed out by a counter do not.
    """
    keys = list(keys)
    span = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    span = span.select(*keys, F.col("_lo").alias("_from"), F.greatest(F.lit(1.0), (F.col("_hi").cast("double") - F.col("_lo") + 1) / F.ceil(F.col("_n") / piece)).alias("_width"))
    cut = df.join(span, keys).withColumn("_piece", F.floor((F.col(value).cast("double") - F.col("_from")) / F.col("_width"))).drop("_from", "_width")
    counts = cut.groupBy(*keys, "_piece").agg(F.count("*").alias("_c"))
    upto = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*keys, "_piece", F.coalesce(F.sum("_c").over(upto), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(*keys, "_piece").orderBy(value))
    return cut.withColumn("_within", within).join(before, [*keys, "_piece"]).withColumn(name, F.col("_before") + F.col("_within")).drop("_piece", "_within", "_before")


def event_order(event):
    """Position of each event on its company's timeline, split by company and day so that no task orders a whole company.

    The place of a day is the running total of the days before it; only events of one day are ordered together.
    """
    per_day = event.groupBy("subject_code", "event_date").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("subject_code").orderBy("event_date").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    offsets = per_day.select("subject_code", "event_date", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("subject_code", "event_date").orderBy("event_id"))
    return event.withColumn("at", within).join(offsets, ["subject_code", "event_date"]).withColumn(
        "position", F.col("before") + F.col("at")).drop("at", "before")


def evaluation_pool(company, controller, position, n=300):
    """Companies with a controller first, then those with positions, then the rest; first n."""
    tagged = (controller.select("stock_code", F.lit(0).alias("priority")).unionAll(position.select("stock_code", F.lit(1)))
              .unionAll(company.select("stock_code", F.lit(2))))
    best = tagged.groupBy("stock_code").agg(F.min("priority").alias("priority"))
    return best.orderBy("priority", "stock_code").limit(n)


def stratified_sample(df, stratum, key, n, seed=42):
    """n rows per stratum in the order of a seeded hash."""
    return first_per_key(df, [stratum], [F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.col(key)], n)


def _review_ranks(df):
    rule = F.substring_index("rule_id", "+", 1)
    at = F.coalesce(F.try_element_at(F.create_map(*[x for i, r in enumerate(S.REVIEW_RULE_ORDER) for x in (F.lit(r), F.lit(i))]),
                                     rule), F.lit(99))
    conf = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "medium", 1).when(
        F.col("confidence") == "low", 2).otherwise(9)
    return df.withColumn("rule_order", at).withColumn("conf_order", conf)


def review_order(df):
    return _review_ranks(df).orderBy("rule_order", "conf_order", F.desc("score_c"))


def review_order_of(met, alone, scores) -> DataFrame:
    """review_order of met and alone parties (see found), of which the latter are many and have one of a few scores: they are put where they belong and
    only the others are sorted. scores: what alone parties may have."""
    met, alone, score = _review_ranks(met), _review_ranks(alone), F.col("score_c")
    head = (F.col("rule_order") == S.REVIEW_RULE_ORDER.index("R2")) & (F.col("conf_order") == 0)
    order, above, out = ["rule_order", "conf_order", F.desc("score_c")], None, []
    for at in sorted(scores, reverse=True):
        between = head & (score > at) & (score < above if above is not None else F.lit(True))
        out += [met.where(between).orderBy(*order), met.where(head & (score == at)), alone.where(score == at)]
        above = at
    out.append(met.where(~head | (score < min(scores))).orderBy(*order))
    rows = out[0].select(*alone.columns)
    for part in out[1:]:
        rows = rows.unionAll(part.select(*alone.columns))
    return rows


def records(position, holding) -> DataFrame:
    """Positions and holdings as records of an entity, positions first."""
    return position.select(
        "entity_id", F.lit("position").alias("table"), F.lit(0).alias("t"), "id", "stock_code",
        F.coalesce("title", F.lit("")).alias("title"), F.coalesce("valid_from", F.lit("")).alias("valid_from"),
        F.coalesce("source", F.lit("")).alias("source")).unionAll(holding.select(
            "entity_id", F.lit("holding"), F.lit(1), "id", "stock_code", F.lit(""), F.coalesce("valid_from", F.lit("")),
            F.coalesce("source", F.lit(""))))


def shared_names(parties, pairs, name="party_name"):
    """Names on both sides of given company pairs (columns a, b)."""
    left = pairs.join(parties.select(F.col("subject_code").alias("a"), F.col(name).alias("name")).distinct(), "a")
    right = parties.select(F.col("subject_code").alias("b"), F.col(name).alias("name")).distinct()
    return left.join(right, ["b", "name"], "left_semi").select("a", "b", "name")
