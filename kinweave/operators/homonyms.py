"""Splitting of persons that were merged because they share a name.

A record is a position or holding of the person. Scores are whole thousandths, so no decision hangs on a rounded double.
"""
from pyspark.sql import DataFrame, Window, functions as F

from kinweave import settings as S
from kinweave.operators import summaries
from kinweave.operators.skew import spread_join
from kinweave.session import written

#: Ids of a person's clusters; a person has fewer records.
CLUSTER_IDS = 1_000_000_000
MIN_RECORDS = 5


def _day(c):
    head = F.substring(c, 1, 10)
    return F.coalesce(F.try_to_date(head, "yyyy-MM-dd"), F.try_to_date(head, "yyyyMMdd"))


def within_days(a, b, days):
    """True or false, null where a date cannot be read."""
    return F.abs(F.datediff(_day(a), _day(b))) <= days


def name_rarity(n):
    return F.when(n <= 2, 900).when(n <= 5, 600).when(n <= 20, 350).otherwise(150)


def holding_cross(source_a, source_b, from_a, from_b):
    holds = [S.CHANGE_SOURCE, S.BATCH_SOURCE]
    same = within_days(from_a, from_b, 365)
    return F.when(source_a.isin(holds) & source_b.isin(holds),
                  F.when(same, 700).when(~same, 500).otherwise(550)).otherwise(500)


def company_count(n):
    return F.when(n <= 3, 700).when(n <= 10, 500).otherwise(200)


def region_match():
    return F.lit(500)


def tenure_overlap(from_a, from_b):
    same = within_days(from_a, from_b, 1095)
    return F.when(same, 650).when(~same, 300).otherwise(500)


def score(n, source_a, source_b, from_a, from_b):
    """Weighted score in thousandths."""
    w = S.SIGNAL_WEIGHTS
    total = (w["name_rarity"] * name_rarity(n) + w["holding_cross"] * holding_cross(source_a, source_b, from_a, from_b)
             + w["company_count"] * company_count(n) + w["region_match"] * region_match()
             + w["tenure_overlap"] * tenure_overlap(from_a, from_b))
    return F.floor((total + 50) / 100).cast("int")


def decision(points):
    """(same person, confidence) from a score, without a model in the middle band: different, medium."""
    return (F.when(points > S.SAME_ABOVE, 1).otherwise(0),
            F.when((points > S.SAME_ABOVE) | (points < S.DIFFERENT_BELOW), "high").otherwise("medium"))


def scored_pairs(pairs: DataFrame) -> DataFrame:
    """All signals, the score and the decision of record pairs.

    pairs: n_companies, a_source, b_source, a_from, b_from, anything else.
    """
    n = F.col("n_companies")
    args = [F.col(c) for c in ("a_source", "b_source", "a_from", "b_from")]
    out = pairs.withColumns({
        "name_rarity": name_rarity(n), "holding_cross": holding_cross(*args), "company_count": company_count(n),
        "region_match": region_match(), "tenure_overlap": tenure_overlap(args[2], args[3]), "score_m": score(n, *args)})
    same, conf = decision(F.col("score_m"))
    return out.withColumns({"same_person": same, "pair_confidence": conf})


def _people(position, holding, entity):
    keep = entity.where("entity_type = 'person' AND is_channel = 0 AND NOT contains(canonical_name, '#D')")
    return summaries.records(position, holding).join(keep.select("entity_id", "canonical_name", "display_name"), "entity_id")


def first_last_pairs(position, holding, entity, at_least=2) -> DataFrame:
    """First and last record of every person with at least two, with the number of its companies."""
    rows = _people(position, holding, entity)
    rec = F.struct("table", "stock_code", "title", "valid_from", "source")
    order = F.struct("t", "id")
    pairs = rows.groupBy("entity_id", "canonical_name", "display_name").agg(
        F.count("*").alias("n_records"), F.min_by(rec, order).alias("a"), F.max_by(rec, order).alias("b")).where(
        F.col("n_records") >= at_least)
    return pairs.join(summaries.company_counts(position, holding), "entity_id").select(
        "entity_id", "canonical_name", "display_name", "n_records", "n_companies",
        *[F.col(f"{s}.{c}").alias(f"{s}_{d}") for s in ("a", "b") for c, d in (
            ("table", "table"), ("stock_code", "code"), ("title", "title"), ("valid_from", "from"), ("source", "source"))])


def numbered_records(position, holding, entity) -> DataFrame:
    """The records of every person in the order in which they are walked, positions first, then holdings. Adds at (from 1)."""
    rows = _people(position, holding, entity)
    # Numbered within each table by counts of pieces, holdings after all positions.
    numbered = summaries.running_count(rows, ["entity_id", "t"], "id", "_in_table")
    before = rows.where("t = 0").groupBy("entity_id").agg(F.count("*").alias("_before"))
    return numbered.join(before, "entity_id", "left").withColumn(
        "at", (F.col("_in_table") + F.when(F.col("t") > 0, F.coalesce("_before", F.lit(0))).otherwise(0)).cast("int")).drop("_in_table", "_before")


def against_representatives(position, holding, entity, min_records=MIN_RECORDS, hot_rows=None) -> DataFrame:
    """Every record against the first records of its person's clusters, in the order in which they were opened, up to the one it matches.

    The walk of clusters() says which cluster a record has joined or opened: it was compared with all that are older, and with the one it
    joined. So the comparisons are a join of the records with the records that opened a cluster; persons with many of both are dealt out.
    Columns: entity_id, table, id, cluster (the one compared with), rep_table, rep_id and those of scored_pairs.
    """
    placed = written(_placed(position, holding, entity, min_records), "placed")
    reps = placed.where("opens").select("entity_id", F.col("cluster").alias("rep_cluster"), F.col("table").alias("rep_table"), F.col("id").alias("rep_id"),
                                        F.col("source").alias("a_source"), F.col("valid_from").alias("a_from"))
    records = placed.select("entity_id", "table", "id", "opens", "cluster", "n_companies", F.col("source").alias("b_source"), F.col("valid_from").alias("b_from"))
    met = spread_join(records, reps, ["entity_id"], ["table", "id"], hot_rows=hot_rows, right_key=["rep_cluster"]).where(
        (F.col("rep_cluster") < F.col("cluster")) | (~F.col("opens") & (F.col("rep_cluster") == F.col("cluster"))))
    return scored_pairs(met.select("entity_id", "table", "id", F.col("rep_cluster").alias("cluster"), "rep_table", "rep_id", "n_companies", "a_source", "b_source",
                                   "a_from", "b_from"))


_STATE = "struct<reps:array<struct<valid_from:string,source:string>>,homes:array<int>,fates:array<int>>"


def clusters(position, holding, entity, min_records=MIN_RECORDS) -> DataFrame:
    """Cluster of every record, see _placed. Columns: entity_id, canonical_name, display_name, table, id, cluster (0-based)."""
    return _placed(position, holding, entity, min_records).select("entity_id", "canonical_name", "display_name", "table", "id", "cluster")


def _placed(position, holding, entity, min_records) -> DataFrame:
    """Cluster of every record: it joins the first cluster whose first record it matches, else opens one.

    The score reads a record's source and date only, and both ways alike. Records of one form (source, date) therefore share their fate:
    all join the cluster of the same earlier form, or all open; those that match themselves open one cluster together, the others
    one each. So the forms of a person, bounded by the calendar, are walked in the order in which they first appear, inside the JVM, and
    the records take their cluster from the walk by joins; their number has no bound.
    """
    rows = numbered_records(position, holding, entity)
    person = ["entity_id", "canonical_name", "display_name"]
    forms = rows.groupBy(*person, "source", "valid_from").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    people = forms.groupBy(*person).agg(F.array_sort(F.collect_list(F.struct("first", "valid_from", "source"))).alias("forms"), F.sum("n").alias("n")).where(
        F.col("n") >= min_records).join(summaries.company_counts(position, holding), "entity_id")
    n = F.col("n_companies")

    def step(state, x):
        matches = F.transform(state["reps"], lambda r: score(n, r["source"], x["source"], r["valid_from"], x["valid_from"])
                              > S.SAME_ABOVE)
        at = F.array_position(matches, True)
        new = at == 0
        return F.struct(
            F.when(new, F.array_append(state["reps"], F.struct(x["valid_from"].alias("valid_from"), x["source"].alias("source"))))
            .otherwise(state["reps"]).alias("reps"),
            F.when(new, F.array_append(state["homes"], x["first"])).otherwise(state["homes"]).alias("homes"),
            F.array_append(state["fates"], F.when(new, F.lit(0)).otherwise(F.get(state["homes"], (at - 1).cast("int")))).alias("fates")
        ).cast(_STATE)

    start = F.struct(F.array().cast("array<struct<valid_from:string,source:string>>").alias("reps"), F.array().cast("array<int>").alias("homes"),
                     F.array().cast("array<int>").alias("fates")).cast(_STATE)
    walked = people.withColumn("fates", F.aggregate("forms", start, step, lambda s: s["fates"])).select(
        F.col("entity_id").alias("_e"), "n_companies", F.explode(F.arrays_zip("forms", "fates")).alias("z"))
    alone = score(n, F.col("z.forms.source"), F.col("z.forms.source"), F.col("z.forms.valid_from"), F.col("z.forms.valid_from")) <= S.SAME_ABOVE
    fates = walked.select("_e", "n_companies", F.col("z.forms.source").alias("_s"), F.col("z.forms.valid_from").alias("_f"), F.col("z.forms.first").alias("_first"),
                          F.col("z.fates").alias("_home"), F.coalesce(alone, F.lit(True)).alias("_alone"))
    met = rows.join(fates, (F.col("entity_id") == F.col("_e")) & F.col("source").eqNullSafe(F.col("_s")) & F.col("valid_from").eqNullSafe(F.col("_f")))
    opens = (F.col("_home") == 0) & (F.col("_alone") | (F.col("at") == F.col("_first")))
    home = F.when(F.col("_home") > 0, F.col("_home")).when(F.col("_alone"), F.col("at")).otherwise(F.col("_first"))
    placed = met.select(*person, "table", "id", "source", "valid_from", "n_companies", "at", opens.alias("opens"), home.alias("_at"))
    number = summaries.running_count(placed.where("opens"), ["entity_id"], "at", "cluster")
    opened = number.select("entity_id", F.col("at").alias("_at"), (F.col("cluster") - 1).cast("int").alias("cluster"))
    return placed.join(opened, ["entity_id", "_at"]).drop("at", "_at")


def split(entity, position, holding, cluster_rows):
    """(entities, positions, holdings) after the split: cluster 0 keeps the person, the others become canonical#D2, #D3, ...

    New ids are negative and built from the person's id and the cluster, so no counter is needed.
    """
    moved = cluster_rows.where("cluster > 0").withColumn("new_id", -(F.col("entity_id") * CLUSTER_IDS + F.col("cluster")))
    fresh = moved.groupBy("entity_id", "canonical_name", "display_name", "cluster", "new_id").agg(F.count("*").alias("n"))
    tag = (F.col("cluster") + 1).cast("string")
    new_rows = fresh.select(
        F.col("new_id").alias("entity_id"), F.lit("person").alias("entity_type"),
        F.concat("canonical_name", F.lit("#D"), tag).alias("canonical_name"), "display_name",
        F.array("display_name").alias("raw_names"), F.lit(0).alias("is_channel"), F.lit("medium").alias("confidence"),
        F.concat(F.lit("split from E:"), F.col("entity_id").cast("string"), F.lit(" cluster"), tag, F.lit(" (records="),
                 F.col("n").cast("string"), F.lit(")")).alias("disambig_note"))
    def repoint(df, table):
        moves = moved.where(F.col("table") == table).select("id", "entity_id", "new_id")
        return df.join(moves, ["id", "entity_id"], "left").withColumn("entity_id", F.coalesce("new_id", "entity_id")).select(*df.columns)
    return entity.unionByName(new_rows, allowMissingColumns=True), repoint(position, "position"), repoint(holding, "holding")


def undo_map(entity) -> DataFrame:
    """Split entity -> the entity of the same display name that is no split."""
    parents = entity.where("NOT contains(canonical_name, '#D')").groupBy("display_name").agg(F.min("entity_id").alias("parent_id"))
    return entity.where("contains(canonical_name, '#D')").join(parents, "display_name").select("entity_id", "parent_id")


def undo(fact, entity) -> DataFrame:
    return fact.join(undo_map(entity), "entity_id", "left").withColumn(
        "entity_id", F.coalesce("parent_id", "entity_id")).select(*fact.columns)


def tier_shares(scored) -> DataFrame:
    """How many pairs the rules decide on their own."""
    s = F.col("score_m")
    return scored.groupBy().agg(F.count("*").alias("n"), F.count_if(s > S.SAME_ABOVE).alias("same"),
                                F.count_if(s < S.DIFFERENT_BELOW).alias("different"),
                                F.count_if((s <= S.SAME_ABOVE) & (s >= S.DIFFERENT_BELOW)).alias("middle"))


def annotation_set(scored, per_tier=85, at_least=200) -> DataFrame:
    """First pairs of each tier by number of records, filled from the middle tier where they are too few."""
    tier = F.when(F.col("score_m") > 750, "high").when(F.col("score_m") < 350, "low").otherwise("mid")
    ranked = summaries.first_per_key(scored.withColumn("tier", tier), ["tier"], [F.desc("n_records"), "entity_id"],
                                     per_tier + at_least)
    base = ranked.where(F.col("rank") <= per_tier)
    missing = base.groupBy().agg(F.greatest(F.lit(0), F.lit(at_least) - F.count("*")).alias("missing"))
    fill = ranked.where((F.col("tier") == "mid") & (F.col("rank") > per_tier)).withColumn("missing", missing.scalar()).where(
        F.col("rank") <= per_tier + F.col("missing")).drop("missing")
    return base.unionByName(fill)
