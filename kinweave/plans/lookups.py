"""Parameterised queries over all companies or over a table of parameters, and the texts made from them."""
from pyspark.sql import DataFrame, Window, functions as F

from kinweave import settings as S
from kinweave.functions.codes import confidence_rank, pad_code
from kinweave.functions.paths import shown_path
from kinweave.operators import network, summaries


def related_parties(parties, params=None, rule_ids=None, min_confidence=None) -> DataFrame:
    """Q1. Rule ids match the whole merged id. params: frame with stock_code. Parties without paths have none here either."""
    rows = parties
    if params is not None:
        rows = rows.join(params.select(F.col("stock_code").alias("subject_code")).distinct(), "subject_code", "left_semi")
    if rule_ids:
        rows = rows.where(F.col("rule_id").isin(rule_ids))
    if min_confidence:
        rows = rows.where(confidence_rank("confidence") >= S.CONFIDENCE_RANK.get(min_confidence, 1))
    path = [shown_path(rows).alias("path")] if "path" in rows.columns else []
    return rows.select("subject_code", F.col("party_name").alias("name"), F.col("rule_id").alias("rule"), "confidence", *path, "score")


def _with_nodes(pairs) -> DataFrame:
    """Sides as nodes of the graph: those given (a_node, b_node), else companies by code."""
    return pairs.withColumns({f"{s}_node": F.col(f"{s}_node") if f"{s}_node" in pairs.columns else F.concat(F.lit("C:"), s) for s in ("a", "b")})


def _hits(parties, params, subject, other, name, order) -> DataFrame:
    """Parties of one side of a pair that are the other side: by id, by name or by a name that contains it."""
    rows = params.join(parties.withColumnRenamed("subject_code", subject), subject)
    same = (F.col("party_id") == F.col(f"{other}_node")) | (F.col("party_name") == F.col(name)) | (
        (F.col(name) != "") & F.col("party_name").contains(F.col(name)))
    return rows.where(same).groupBy("a", "b").agg(F.min_by(F.struct("rule_id", "confidence", "path"), "party_id").alias("h")).select(
        "a", "b", F.lit(order).alias("order"), "h.*")


def relation_of_pairs(parties, pairs, link_rows=None, max_hops=3) -> DataFrame:
    """Q2. Whether b is a party of a, else a of b, else the shortest path. pairs: a, b, a_name, b_name; a_node, b_node where a side may
    be something else than a company."""
    pairs = _with_nodes(pairs)
    best = _hits(parties, pairs, "a", "b", "b_name", 1).unionAll(_hits(parties, pairs, "b", "a", "a_name", 2)).groupBy("a", "b").agg(
        F.min_by(F.struct("rule_id", "confidence", "path"), "order").alias("h"))
    shown = shown_path(best, "h.path")
    out = pairs.select("a", "b", "a_node", "b_node").join(best, ["a", "b"], "left").select(
        "a", "b", "a_node", "b_node", F.col("h.rule_id").alias("rule"), F.col("h.confidence").alias("confidence"), shown.alias("path"))
    if link_rows is None:
        return out.drop("a_node", "b_node").withColumn("related", F.col("rule").isNotNull().cast("int"))
    open_pairs = out.where("rule IS NULL").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    walked = network.shortest_paths(link_rows, open_pairs, max_hops).select(
        F.col("a").alias("a_node"), F.col("b").alias("b_node"), F.array_join("path", " -> ").alias("walk"))
    return out.join(walked, ["a_node", "b_node"], "left").select(
        "a", "b", "rule", "confidence", F.coalesce("path", "walk", F.lit("")).alias("path"),
        (F.col("rule").isNotNull() | F.col("walk").isNotNull()).cast("int").alias("related"))


def reverse_relations(entity, company, controller, holding, position, relation_type=None, min_ratio=None) -> DataFrame:
    """Q3. Companies an entity controls, holds or serves. Only control leaves channels out."""
    c = company.select("stock_code", "short_name")
    parts = {
        "control": lambda: controller.join(entity.where("is_channel = 0").select("entity_id"), "entity_id", "left_semi").select(
            "entity_id", "stock_code", F.lit("control").alias("relation"), F.col("control_ratio").alias("ratio"),
            F.lit(None).cast("string").alias("title")),
        "hold": lambda: _held(holding, min_ratio),
        "serve": lambda: position.select("entity_id", "stock_code", F.lit("serve"), F.lit(None).cast("double"), "title"),
    }
    out = None
    for name, part in parts.items():
        if relation_type in (None, name):
            out = part() if out is None else out.unionAll(part())
    return out.join(c, "stock_code")


def _held(holding, min_ratio):
    rows = holding.groupBy("entity_id", "stock_code").agg(F.max("ratio").alias("ratio"))
    if min_ratio:
        rows = rows.where(F.coalesce("ratio", F.lit(0.0)) >= min_ratio)
    return rows.select("entity_id", "stock_code", F.lit("hold").alias("relation"), "ratio", F.lit(None).cast("string").alias("title"))


def holders(holding, entity, n=10):
    return summaries.top_holders(holding, entity, n)


def controllers(controller, entity):
    return controller.join(entity.where("is_channel = 0").select("entity_id", "display_name", "entity_type"), "entity_id")


def officers(position, entity):
    return position.join(entity.select("entity_id", "display_name"), "entity_id")


def company_roles(entity, holding, controller, position, role="all", n=10) -> DataFrame:
    """Q4. Holders, controllers and officers, one row each."""
    none = lambda t: F.lit(None).cast(t)
    parts = {
        "holder": lambda: holders(holding, entity, n).select(
            "stock_code", F.lit("holder").alias("role"), "display_name", "entity_type", "is_channel", "ratio", none("string").alias("title"),
            F.col("rank").cast("bigint").alias("at")),
        "controller": lambda: controllers(controller, entity).select(
            "stock_code", F.lit("controller"), "display_name", "entity_type", F.lit(0), "control_ratio", none("string"), "id"),
        "director": lambda: officers(position, entity).select(
            "stock_code", F.lit("director"), "display_name", none("string"), none("int"), none("double"), "title", "id"),
    }
    out = None
    for name, part in parts.items():
        if role in ("all", name):
            out = part() if out is None else out.unionAll(part())
    return out


def risk_events(event, event_types=None, date_range=None) -> DataFrame:
    """Q5. Events of a company in date order."""
    rows = event
    if event_types:
        rows = rows.where(F.col("event_type").isin(event_types))
    if date_range:
        rows = rows.where(F.col("event_date").between(*date_range))
    return summaries.event_order(rows)


def _first_by_name(parties, code):
    first = F.struct("rule_id", "confidence", "path")
    return parties.groupBy(F.col("subject_code").alias(code), F.col("party_name").alias("name")).agg(
        F.min_by(first, "party_id").alias(f"{code}_party"))


def overlap(parties, pairs) -> DataFrame:
    """Q6. Parties of both companies, by name, with the rule on each side. pairs: a, b."""
    left = pairs.select("a", "b").join(_first_by_name(parties, "a"), "a")
    return left.join(_first_by_name(parties, "b"), ["b", "name"]).select(
        "a", "b", "name", F.col("a_party.rule_id").alias("rule_a"), F.col("b_party.rule_id").alias("rule_b"),
        F.col("a_party.confidence").alias("confidence"), shown_path(left, "a_party.path").alias("path"))


def overlap_as_of(parties, pairs) -> DataFrame:
    """Q6 with dates: parties as of dates (see as_of), pairs with a, b, as_of. A company on a date is a subject of its own."""
    at = lambda c: F.concat(F.col(c), F.lit("@"), F.coalesce("as_of", F.lit("")))
    dated = overlap(parties.withColumn("subject_code", at("subject_code")), pairs.select(at("a").alias("a"), at("b").alias("b")))
    of = lambda c, part: F.nullif(F.split_part(c, F.lit("@"), F.lit(part)), F.lit(""))
    return dated.withColumns({"as_of": of("a", 2), "a": of("a", 1), "b": of("b", 1)})


def dossier_counts_as_of(parties, gold_scoped, asks) -> DataFrame:
    """Q9 with dates: per asked company and date the parties in three classes, counted."""
    from kinweave.functions import names
    known = gold_scoped.select("stock_code", names.alignment_name("party_name").alias("name")).where("name <> ''").distinct()
    found = parties.select(F.col("subject_code").alias("stock_code"), "as_of", names.alignment_name("party_name").alias("name"))
    by_name = found.groupBy("stock_code", "as_of", "name").agg(F.count("*").alias("n"))
    per = by_name.join(known.withColumn("g", F.lit(1)), ["stock_code", "name"], "left").groupBy("stock_code", "as_of").agg(
        F.count("g").alias("n_matched"), F.coalesce(F.sum(F.when(F.col("g").isNull(), F.col("n"))), F.lit(0)).alias("n_system_only"))
    total = known.groupBy("stock_code").agg(F.count("*").alias("n_known"))
    rows = asks.select("stock_code", "as_of").distinct().join(
        per.select(F.col("stock_code").alias("c"), F.col("as_of").alias("d"), "n_matched", "n_system_only"),
        (F.col("stock_code") == F.col("c")) & F.col("as_of").eqNullSafe(F.col("d")), "left").drop("c", "d").join(total, "stock_code", "left")
    rows = rows.na.fill(0, ["n_matched", "n_system_only", "n_known"])
    return rows.select("stock_code", "as_of", "n_matched", "n_system_only", (F.col("n_known") - F.col("n_matched")).alias("n_gold_only"))


def parties_in_industry(parties, company, industry) -> DataFrame:
    """Q7, second example: related parties of all companies that are companies of an industry."""
    c = company.where(F.col("industry") == industry).select(F.concat(F.lit("C:"), "stock_code").alias("party_id"), "industry")
    return parties.join(c, "party_id").select("subject_code", "party_id", "party_name", "rule_id", "industry")


def largest_holders(holding, entity, n=10) -> DataFrame:
    """Q7, third example: the n largest disclosed ratios."""
    per = holding.groupBy("entity_id", "stock_code").agg(F.max("ratio").alias("ratio")).where("ratio IS NOT NULL")
    best = summaries.top(per, n, F.desc("ratio"), "entity_id", "stock_code")
    return best.join(entity.select("entity_id", "display_name"), "entity_id")


def comparison(pairs, company, entity, holding, controller, position, event, parties, shared=None) -> DataFrame:
    """Q8. Two companies side by side: one row per figure (block, item, value_a, value_b).

    shared: the names both companies of a pair have as parties (a, b, name), where they are known. Every block is computed once for the companies of the pairs and joined to both sides.
    """
    wanted = pairs.select(F.col("a").alias("stock_code")).unionAll(pairs.select("b")).distinct()
    only = lambda df, code="stock_code": df.join(wanted.withColumnRenamed("stock_code", code), code, "left_semi")
    blocks = only(company).select("stock_code", F.explode(F.array(*[
        F.struct(F.lit("basic").alias("block"), F.lit(k).alias("item"), F.col(k).cast("string").alias("value"))
        for k in ("short_name", "industry", "is_st")])).alias("x")).select("stock_code", "x.*")
    named = only(holders(holding, entity)).select(
        "stock_code", F.lit("holders"), F.lpad(F.col("rank").cast("string"), 2, "0"),
        F.concat("display_name", F.coalesce(F.concat(F.lit(" "), F.col("ratio").cast("string"), F.lit("%")), F.lit(""))))
    heads = only(controllers(controller, entity)).select("stock_code", F.lit("controllers"), "display_name", F.col("control_ratio").cast("string"))
    related = only(parties, "subject_code").groupBy("subject_code").agg(F.count("*").alias("n")).select(
        "subject_code", F.lit("related"), F.lit("n"), F.col("n").cast("string"))
    people = only(officers(position, entity)).groupBy("stock_code").agg(F.count("*").alias("n")).select(
        "stock_code", F.lit("directors"), F.lit("n"), F.col("n").cast("string"))
    events = only(summaries.event_totals(event, ("subject_code", "event_type")), "subject_code").select(
        "subject_code", F.lit("events"), "event_type", F.concat_ws("|", F.col("n").cast("string"), F.col("total_amount").cast("string")))
    flat = blocks.unionAll(named).unionAll(heads).unionAll(related).unionAll(people).unionAll(events)
    side = lambda code: flat.select(F.col("stock_code").alias(code), "block", "item", F.col("value").alias(f"value_{code}"))
    one = pairs.select("a", "b").join(side("a"), "a").join(
        pairs.select("a", "b").join(side("b"), "b"), ["a", "b", "block", "item"], "full_outer")
    shared = (overlap(parties, pairs) if shared is None else shared).groupBy("a", "b").agg(F.count("*").alias("n")).select(
        "a", "b", F.lit("related").alias("block"), F.lit("n_overlap").alias("item"), F.col("n").cast("string").alias("value_a"))
    staff = officers(position, entity).select(F.col("stock_code").alias("subject_code"), F.col("display_name").alias("party_name"))
    crossing = summaries.shared_names(staff, pairs).groupBy("a", "b").agg(F.count("*").alias("n")).select(
        "a", "b", F.lit("directors"), F.lit("cross_count"), F.col("n").cast("string"))
    both = shared.unionAll(crossing).withColumn("value_b", F.col("value_a"))
    return one.select("a", "b", "block", "item", "value_a", "value_b").unionByName(both)


def fact_sheet(company, holding, entity, n=10) -> DataFrame:
    """Q10. First holders of the snapshot feed by order, without channels, each with its largest known ratio."""
    rows = summaries.holders_by_name(holding, entity, [S.BATCH_SOURCE], with_channels=False).drop("ratio").groupBy(
        "stock_code", "display_name", "entity_type").agg(F.min("first_id").alias("first_id"))
    first = summaries.first_per_key(rows, ["stock_code"], ["first_id", "display_name"], n, rank="holder_rank")
    return first.join(summaries.ratio_by_name(holding, entity), ["stock_code", "display_name"], "left").drop("first_id")


def pair_related(pairs, controller, holding, entity) -> DataFrame:
    """Q11. Pairs (a, b) with a shared controller or a shared non-channel holder."""
    heads = controller.select("stock_code", F.concat(F.lit("c"), F.col("entity_id").cast("string")).alias("tie"))
    live = holding.join(entity.where("is_channel = 0").select("entity_id"), "entity_id", "left_semi")
    ties = heads.unionAll(live.select("stock_code", F.concat(F.lit("h"), F.col("entity_id").cast("string")))).distinct()
    left = pairs.select("a", "b").distinct().join(ties.withColumnRenamed("stock_code", "a"), "a")
    hit = left.join(ties.withColumnRenamed("stock_code", "b"), ["b", "tie"], "left_semi").select("a", "b").distinct().withColumn(
        "related", F.lit(1))
    return pairs.select("a", "b").distinct().join(hit, ["a", "b"], "left").na.fill(0, ["related"])


def random_company(company, controller, seed=42) -> DataFrame:
    """Q12. One company with a controller, by a seeded hash."""
    return company.join(controller.select("stock_code"), "stock_code", "left_semi").select("stock_code", "short_name").orderBy(
        F.md5(F.concat(F.lit(f"{seed}:"), "stock_code")), "stock_code").limit(1)


def company_by_code(company, codes) -> DataFrame:
    """Q15. Companies by code, padded. codes: frame with code."""
    return company.join(codes.select(pad_code("code").alias("stock_code")).distinct(), "stock_code", "left_semi")


# ---- dossiers ----
def _list(df, key, order, fields, n, name):
    """First n rows per key, or all without n, as an array in order."""
    first = summaries.first_per_key(df, [key], order, n, rank="_at") if n else df.withColumn("_at", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    arr = first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", F.struct(*fields).alias("v")))),
                                             lambda x: x["v"]).alias(name))
    return arr


def _dossier_holders(holding, entity):
    known_ratio = summaries.ratio_by_name(holding.where(F.col("source") == S.CHANGE_SOURCE), entity).withColumnRenamed("ratio", "_r")
    rows = holding.join(entity.select("entity_id", "display_name", "entity_type", "is_channel", "confidence"), "entity_id").groupBy(
        "stock_code", "entity_id", "display_name", "entity_type", "is_channel", "confidence").agg(
        F.max("ratio").alias("ratio"), F.min("id").alias("ord"))
    top = summaries.first_per_key(rows, ["stock_code"], ["ord", "entity_id"], 10, rank="_rk").join(
        known_ratio, ["stock_code", "display_name"], "left").withColumn("ratio", F.coalesce("ratio", "_r"))
    return _list(top, "stock_code", ["ord", "entity_id"], ["display_name", "ratio", "entity_type", "is_channel", "confidence"], 10, "holders")


def dossier_heads(company, entity, holding, event, disclosed) -> DataFrame:
    """The head of every dossier: basics, holders and the counts of disclosed parties and events, without its lists of parties and events.

    disclosed: stock_code, n_matched, n_gold_only (see evaluation.disclosed_counts).
    """
    n_ev = event.groupBy(F.col("subject_code").alias("stock_code")).agg(F.count("*").alias("n_events"))
    out = company
    for part in (_dossier_holders(holding, entity), disclosed, n_ev):
        out = out.join(part, "stock_code", "left")
    return out.na.fill(0, ["n_matched", "n_gold_only", "n_events"])


def dossiers(company, entity, holding, controller, parties, aligned, event, leading_proof, list_limit=None, notes=None) -> DataFrame:
    """Q9. One row per company: basics, holders, controllers, parties in three classes, events, notes.

    A dossier is one document per company and lists everything; with a list_limit it shows the first of each list, whose full length is in the
    counts. dossier_items has the same as rows.
    leading_proof: first pieces of evidence per pair. aligned: stock_code, name, side.
    """
    from kinweave.functions import names
    h = _dossier_holders(holding, entity)
    c = _list(controllers(controller, entity), "stock_code", ["id"], ["display_name", "control_ratio", "entity_type"], list_limit, "controllers")
    sides = aligned.groupBy("stock_code").agg(*[F.count_if(F.col("side") == s).alias(f"n_{s}") for s in ("matched", "gold_only")])
    matched = _list(aligned.where("side = 'matched'"), "stock_code", ["name"], ["name"], list_limit, "matched")
    gold_only = _list(aligned.where("side = 'gold_only'"), "stock_code", ["name"], ["name"], list_limit, "gold_only")
    hits = aligned.where("side = 'matched'").select("stock_code", "name")
    new = parties.withColumnRenamed("subject_code", "stock_code").withColumn("name", names.alignment_name("party_name")).join(
        hits, ["stock_code", "name"], "left_anti")
    n_new = new.groupBy("stock_code").agg(F.count("*").alias("n_system_only"))
    proof = leading_proof.select(F.col("subject_code").alias("stock_code"), "party_id", F.slice("evidence", 1, 2).alias("evidence"))
    shown = new.withColumn("_rk", F.row_number().over(Window.partitionBy("stock_code").orderBy(F.desc("score_c"), "party_id"))).join(
        proof, ["stock_code", "party_id"], "left").withColumn("path", shown_path(new))
    found = _list(shown, "stock_code", ["_rk"], [F.col("party_name").alias("name"), F.col("rule_id").alias("rule"), "confidence", "path",
                                                 "score", "evidence"], list_limit, "system_only")
    ev = event.withColumnRenamed("subject_code", "stock_code")
    n_ev = ev.groupBy("stock_code").agg(F.count("*").alias("n_events"))
    e = _list(ev, "stock_code", ["event_date", "event_id"], ["event_type", "event_date", "counterparty", "amount", "summary", "source_type"],
              list_limit, "events")
    out = company
    for part in (h, c, sides, n_new, matched, found, gold_only, n_ev, e):
        out = out.join(part, "stock_code", "left")
    counts = ["n_matched", "n_gold_only", "n_system_only", "n_events"]
    return out.na.fill(0, counts).withColumn("disclaimer", F.struct(*[F.lit(v).alias(k) for k, v in (notes or S.DOSSIER_NOTES).items()]))


def dossier_items(entity, controller, parties, aligned, event) -> DataFrame:
    """Everything a dossier lists, one JSON item per row, whatever the length of a company's lists."""
    def items(df, key, section, *fields):
        return df.select(F.col(key).alias("stock_code"), F.lit(section).alias("section"), F.to_json(F.struct(*fields)).alias("item"))
    return (items(controllers(controller, entity), "stock_code", "controllers", "display_name", "control_ratio", "entity_type")
            .unionAll(items(aligned.where("side <> 'system_only'"), "stock_code", "disclosed", "name", "side"))
            .unionAll(items(parties, "subject_code", "found", "party_name", "rule_id", "confidence", "score"))
            .unionAll(items(event, "subject_code", "events", "event_type", "event_date", "counterparty", "amount", "summary", "source_type")))


def dossier_json(rows) -> DataFrame:
    return rows.select("stock_code", F.to_json(F.struct(*rows.columns)).alias("dossier"))


def write_dossiers(rows, path):
    """One JSON line per company."""
    dossier_json(rows).write.mode("overwrite").json(path)


def _joined(df, keys, order, line, name):
    """The lines of each key in order, one below the other."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(line).alias("_line"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda x: x["_line"]), "\n").alias(name))


def role_lines(roles) -> DataFrame:
    """Q13. The roles of a company as lines of text, one row per line, in block order: holders, controllers, officers."""
    share = F.coalesce(F.concat(F.col("ratio").cast("string"), F.lit("%")), F.lit("?"))
    line = (F.when(F.col("role") == "holder", F.concat_ws("; ", F.concat(F.lit("#"), F.col("at").cast("string"), F.lit(" "), F.col("display_name")), share, "entity_type",
                                                          F.when(F.col("is_channel") == 1, "channel")))
            .when(F.col("role") == "controller", F.concat_ws("; ", "display_name", share))
            .otherwise(F.concat_ws("; ", "display_name", "title")))
    block = F.when(F.col("role") == "holder", 0).when(F.col("role") == "controller", 1).otherwise(2)
    return roles.select("stock_code", block.alias("block"), "at", line.alias("line"))


def role_text(lines) -> DataFrame:
    """Lines joined to one text per company, each block under its name. For companies whose lines fit a cell; the lines themselves have no such bound."""
    heads = F.array(*[F.lit(f"[{x}]") for x in ("holders", "controllers", "officers")])
    per = _joined(lines, ["stock_code", "block"], ["at"], "line", "t").withColumn("t", F.concat(F.get(heads, F.col("block")), F.lit("\n"), "t"))
    return _joined(per, ["stock_code"], ["block"], "t", "text")


def event_text(event, shown=5) -> DataFrame:
    """Q13. The events of a company as text: per type a line with number and amount, then the first ones by date.

    Types stand in the order of their first event.
    """
    label = F.coalesce(F.create_map(*[F.lit(x) for kv in S.EVENT_LABELS.items() for x in kv])[F.col("event_type")], F.col("event_type"))
    totals = summaries.event_totals(event, ("subject_code", "event_type"))
    line = F.concat_ws("; ", F.coalesce("event_date", F.lit("?")), F.left(F.coalesce("summary", F.lit("")), F.lit(60)), "counterparty")
    first = summaries.first_per_key(event.withColumn("line", line), ["subject_code", "event_type"], ["event_date", "event_id"], shown)
    start = first.where("rank = 1").select("subject_code", "event_type", "event_date", "event_id")
    head = F.concat(F.lit("["), label, F.lit("] "), F.col("n").cast("string"), F.lit("; "), F.col("total_amount").cast("string"))
    per = totals.join(_joined(first, ["subject_code", "event_type"], ["rank"], "line", "lines"), ["subject_code", "event_type"]).join(start, ["subject_code", "event_type"])
    return _joined(per.withColumn("block", F.concat(head, F.lit("\n"), "lines")), ["subject_code"], ["event_date", "event_id"], "block", "text").withColumnRenamed(
        "subject_code", "stock_code")


def dossier_text(rows, shown=10, notes=None) -> DataFrame:
    """Q14. A dossier as plain text: a line for each fact, under the name of its list with the length of the whole list."""
    none = F.array().cast("array<string>")
    text = lambda c: F.coalesce(c.cast("string"), F.lit("?"))

    def block(name, items, line, count=None):
        many = F.coalesce(F.transform(F.slice(items, 1, shown), line), none)
        total = F.col(count) if count else F.coalesce(F.size(items), F.lit(0))
        return F.concat(F.array(F.concat(F.lit(f"[{name}] "), F.greatest(total, F.lit(0)).cast("string"))), many)
    words = lambda *parts: F.concat_ws("; ", *parts)
    parts = [
        F.array(words("stock_code", "short_name", text(F.col("industry")))),
        block("holders", F.col("holders"), lambda x: words(x["display_name"], text(x["ratio"]), x["entity_type"])),
        block("controllers", F.col("controllers"), lambda x: words(x["display_name"], text(x["control_ratio"]))),
        block("disclosed and found", F.col("matched"), lambda x: x["name"], "n_matched"),
        block("found only", F.col("system_only"), lambda x: words(x["name"], x["rule"], x["confidence"], x["path"]), "n_system_only"),
        block("disclosed only", F.col("gold_only"), lambda x: x["name"], "n_gold_only"),
        block("events", F.col("events"), lambda x: words(text(x["event_date"]), x["event_type"], text(x["amount"].cast("decimal(18,2)")), x["summary"]), "n_events"),
        F.array(*[F.lit(f"{k}: {v}") for k, v in (notes or S.DOSSIER_NOTES).items()])]
    return rows.select("stock_code", F.array_join(F.concat(*parts), "\n").alias("text"))
