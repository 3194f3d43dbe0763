"""Batch understanding of a table of questions: intent, slots, references to earlier turns, and the audit of SQL texts."""
import re

from pyspark.sql import DataFrame, functions as F

from kinweave import settings as S
from kinweave.functions.names import contains_any, matcher_norm, normalize_name
from kinweave.plans import linking
from kinweave.session import written


def _starts(q, patterns):
    return q.rlike("|".join(f"^(?:{p})" for p in patterns))


def intent(question):
    """Struct of intent, confidence (percent), rule_hit and uncertain, first rule that applies."""
    q = F.trim(question)
    w = {k: contains_any(q, v) for k, v in S.INTENT_WORDS.items()}
    hit = lambda k: w[k] | _starts(q, S.INTENT_PATTERNS[k])
    rules = [
        ("Q8", w["Q8"], 95, "compare_keyword"),
        ("Q6", hit("Q6"), 95, "keyword/pattern"),
        ("Q2", q.rlike(S.TWO_CODES) & w["Q2"], 95, "two_code+keyword"),
        ("Q2", q.rlike(S.TWO_NAMES) & w["Q2"], 85, "two_entity+keyword"),
        ("Q3", _starts(q, S.INTENT_PATTERNS["Q3"]), 90, "pattern"),
        ("Q3", w["Q3"] & q.rlike("哪些|哪家"), 85, "keyword+哪些"),
        ("Q5", hit("Q5"), 90, "keyword/pattern"),
        ("Q4", hit("Q4"), 90, "keyword/pattern"),
        ("Q1", hit("Q1"), 90, "keyword/pattern"),
    ]
    out = None
    for name, cond, conf, why in rules:
        value = F.struct(F.lit(name).alias("intent"), F.lit(conf).alias("confidence"), F.lit(why).alias("rule_hit"), F.lit(0).alias("uncertain"))
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(F.struct(F.lit("Q7").alias("intent"), F.lit(30).alias("confidence"), F.lit("fallback").alias("rule_hit"),
                                  F.lit(1).alias("uncertain")))


def simple_intent(question):
    """The older four-way routing."""
    q = F.trim(question)
    return (F.when(q.rlike(S.TWO_CODES) & q.rlike(S.SIMPLE_RELATIONSHIP), "relation_explain")
            .when(q.rlike(S.SIMPLE_RELATION), "related_party").when(q.rlike(S.SIMPLE_FACT), "fact_query").otherwise("open_qa"))


def role_type(q):
    out = None
    for word, role in sorted(S.ROLE_WORDS.items(), key=lambda kv: -len(kv[0])):
        out = F.when(q.contains(word), role) if out is None else out.when(q.contains(word), role)
    return out.otherwise("all")


def relation_type(q):
    return (F.when(q.contains("控制"), "control").when(q.rlike("持股|持有"), "hold").when(q.rlike("任职|担任"), "serve"))


def event_types(q):
    found = F.array_compact(F.array(*[F.when(q.contains(w), t) for w, t in S.EVENT_WORDS.items()]))
    return F.array_sort(F.array_distinct(found))


def slots(questions, company, entity) -> DataFrame:
    """Slots of every question by its intent. questions: id, text, intent, context_code (may be null).

    One wide row per question; `filled` is 0 where the intent's required slots stay open, `clarify` 1 where a name stands
    for several.
    """
    hits = written(linking.dictionary_hits(questions, linking.company_dictionary(company)), "question-hits")
    one = linking.company_match(questions, company, hits=hits).select("id", F.col("word").alias("c_word"), "n_codes", F.col("code").alias("c_code"))
    two = linking.first_two_matches(questions, company, hits=hits)
    people = linking.first_two_persons(questions, entity)
    r = questions.join(one, "id", "left").join(two, "id", "left").join(people, "id", "left")
    q, ctx, i = F.col("text"), F.col("context_code"), F.col("intent")
    found = F.col("c_word").isNotNull()
    company_slot = F.when(found, F.coalesce("c_code", F.lit(""))).otherwise(ctx)
    single = i.isin("Q1", "Q4", "Q5")
    pair = i.isin("Q6", "Q8")
    first_two = F.array_compact(F.array(
        F.when(F.col("word_1").isNotNull(), F.when(F.col("n_codes_1") == 1, F.col("code_1")).otherwise("")),
        F.when(F.col("word_2").isNotNull(), F.when(F.col("n_codes_2") == 1, F.col("code_2")).otherwise(""))))
    both = F.when(F.size(first_two) < 2, F.array_compact(F.concat(first_two, F.array(ctx)))).otherwise(first_two)
    p1, p2 = F.col("person_1"), F.col("person_2")
    a = (F.when(F.size(both) >= 2, F.get(both, F.lit(0))).when(p1.isNotNull() & (p2.isNotNull() | (F.size(both) >= 1)), p1))
    b = (F.when(F.size(both) >= 2, F.get(both, F.lit(1))).when(p1.isNotNull(), F.coalesce(p2, F.get(both, F.lit(0)))))
    one_entity = F.coalesce(F.when(F.col("n_1") == 1, F.col("entity_1").cast("string")), p1, F.col("c_word"))
    out = r.select(
        "id", "intent",
        F.when(single, company_slot).alias("company"),
        F.when(i == "Q2", a).alias("entity_a"), F.when(i == "Q2", b).alias("entity_b"),
        F.when(i == "Q3", one_entity).alias("entity"), F.when((i == "Q3") & one_entity.isNotNull(), relation_type(q)).alias("relation_type"),
        F.when((i == "Q4") & company_slot.isNotNull(), role_type(q)).alias("role_type"),
        F.when((i == "Q5") & company_slot.isNotNull(), F.array_join(event_types(q), ",")).alias("event_types"),
        F.when(pair & (F.size(both) >= 2), F.get(both, F.lit(0))).alias("company_a"),
        F.when(pair & (F.size(both) >= 2), F.get(both, F.lit(1))).alias("company_b"),
        F.coalesce(F.when(single, found & F.col("c_code").isNull()).when(i.isin("Q2", "Q6", "Q8"), F.array_contains(F.slice(both, 1, 2), ""))
                   .when(i == "Q3", F.when(p1.isNotNull(), F.col("n_1") > 1).otherwise(found & F.col("c_code").isNull())),
                   F.lit(False)).cast("int").alias("clarify"))
    return out.withColumn("filled", F.coalesce("company", "entity_a", "entity", "company_a").isNotNull().cast("int"))


def link_slots(slot_rows, company, entity, holding) -> DataFrame:
    """Slots resolved to codes and entities, in long form: id, slot, input, value, method, state (linked / clarify / error).

    Six-digit codes and entity ids pass; the slots of a comparison are not linked.
    """
    per_intent = {"company": ["Q1", "Q4", "Q5"], "entity_a": ["Q2"], "entity_b": ["Q2"], "entity": ["Q3"], "company_a": ["Q6"], "company_b": ["Q6"]}
    cells = F.array_compact(F.array(*[
        F.when(F.col("intent").isin(v) & F.col(k).isNotNull(), F.struct(F.lit(k).alias("slot"), F.col(k).alias("input"))) for k, v in per_intent.items()]))
    rows = written(slot_rows.select("id", F.explode(cells).alias("x")).select("id", "x.*"), "slot-cells")
    known = F.col("input").rlike(r"^\d+$") & ((F.char_length("input") == 6) | (F.col("slot") == "entity"))
    passed = rows.where(known).select("id", "slot", "input", F.col("input").alias("value"), F.lit("given").alias("method"), F.lit("linked").alias("state"))
    open_rows = rows.where(~known)
    companies = linking.link_company(open_rows.where("slot LIKE 'company%'").select(F.col("input").alias("text")), company).select(
        F.col("text").alias("input"), F.col("code").alias("value"), "method", "clarify", F.lit("c").alias("kind"))
    entities = linking.link_entity(open_rows.where("slot LIKE 'entity%'").select(F.col("input").alias("text")), company, entity, holding).select(
        F.col("text").alias("input"), F.col("entity_id").cast("string").alias("value"), "method", "clarify", F.lit("e").alias("kind"))
    linked = open_rows.withColumn("kind", F.left("slot", F.lit(1))).withColumn("input", F.trim("input")).join(
        companies.unionAll(entities), ["input", "kind"], "left")
    state = F.when(F.col("value").isNotNull(), "linked").when(F.col("clarify") == 1, "clarify").otherwise("error")
    return passed.unionAll(linked.select("id", "slot", "input", "value", F.coalesce("method", F.lit("not_found")).alias("method"), state.alias("state")))


# ---- references ----
def pronoun(q):
    out = None
    for p in S.PRONOUNS:
        out = F.when(q.contains(p), p) if out is None else out.when(q.contains(p), p)
    return out


def ordinal(q):
    """Zero-based place a question points to, negative from the end, null for none."""
    out = None
    for word, place in sorted(S.ORDINALS.items(), key=lambda kv: -len(kv[0])):
        out = F.when(q.contains(word), place) if out is None else out.when(q.contains(word), place)
    spelled = F.regexp_extract(q, "第([一二三四五六七八九十])个?", 1)
    digits = F.regexp_extract(q, r"第(\d+)个?", 1)
    return out.when(spelled != "", F.instr(F.lit("一二三四五六七八九十"), spelled) - 1).when(digits != "", digits.cast("int") - 1)


def _visible(df, turn="turn"):
    """Rows of a turn are in focus for the turns after it; one row per such turn makes the lookup an equi-join."""
    return df.withColumn("at", F.explode(F.sequence(F.col(turn) + 1, F.col(turn) + 1 + S.FOCUS_TURNS)))


def references(questions, mentions, results, matches=None) -> DataFrame:
    """What each question refers to in the turns before it.

    questions: id, session, turn, text, has_entity (0/1). mentions: session, turn, ord, code, name (the later ord of a turn
    is on top). results: session, turn, pos (0-based), code, name. matches: id, word - the name found in a question.
    """
    top = _visible(mentions).groupBy("session", "at").agg(
        F.count_distinct("code").alias("n_codes"), F.max_by(F.struct("code", "name"), F.struct("turn", "ord")).alias("m"))
    item = _visible(results).groupBy("session", "at").agg(F.min_by(F.struct("code", "name"), F.struct("turn", "pos")).alias("r"))
    last = results.groupBy("session", (F.col("turn") + 1).alias("at")).agg(F.count("*").alias("n_last"))
    q = questions.withColumn("at", F.col("turn"))
    t = F.col("text")
    rows = (q.join(top, ["session", "at"], "left").join(item, ["session", "at"], "left").join(last, ["session", "at"], "left")
            .withColumn("pronoun", pronoun(t)).withColumn("ordinal", ordinal(t))
            .withColumn("omitted", (F.col("has_entity") == 0) & contains_any(t, S.OMISSION_WORDS)))
    n_last = F.coalesce("n_last", F.lit(0))
    place = F.when(F.col("ordinal") < 0, n_last + F.col("ordinal")).otherwise(F.col("ordinal"))
    rows = rows.withColumn("pos", place.cast("int"))
    picked = results.select("session", (F.col("turn") + 1).alias("at"), F.col("pos").cast("int").alias("pos"), F.col("code").alias("o_code"))
    rows = rows.join(picked, ["session", "at", "pos"], "left")
    if matches is not None:
        part = matches.join(questions.select("id", "session", F.col("turn").alias("at")), "id").join(
            results.select("session", (F.col("turn") + 1).alias("at"), "pos", "code", normalize_name("name").alias("n"), matcher_norm("name").alias("n2")),
            ["session", "at"]).where(F.col("n").contains(F.col("word")) | F.col("n2").contains(F.col("word")))
        part = part.groupBy("id").agg(F.count_distinct("pos").alias("n_part"), F.min("code").alias("part_code"))
        rows = rows.join(part, "id", "left")
    else:
        rows = rows.withColumn("n_part", F.lit(None).cast("bigint")).withColumn("part_code", F.lit(None).cast("string"))
    focus = F.coalesce(F.col("m.code"), F.col("r.code"))
    has_p, has_o = F.col("pronoun").isNotNull(), F.col("ordinal").isNotNull()
    kind = (F.when(has_p, "pronoun").when(has_o, "ordinal").when(F.col("omitted"), "omission")
            .when(F.col("n_part") >= 1, "name_fragment").otherwise("none"))
    rows = rows.withColumn("kind", kind)
    k = F.col("kind")
    target = (F.when(k == "pronoun", F.when(F.coalesce("n_codes", F.lit(0)) <= 1, focus)).when(k == "ordinal", F.col("o_code"))
              .when(k == "omission", focus).when(k == "name_fragment", F.when(F.col("n_part") == 1, F.col("part_code"))))
    rows = rows.withColumn("target", target)
    return rows.select("id", "session", "turn", "kind", "target", F.col("target").isNotNull().cast("int").alias("resolved"),
                       ((k != "none") & F.col("target").isNull()).cast("int").alias("clarify"))


# ---- audit of SQL texts ----
def audit_sql(log, text="sql") -> DataFrame:
    """First finding of each check on logged SQL texts; nothing is executed. Adds structure, readonly, resource ('OK' or why)."""
    c = F.col(text)
    tables = F.regexp_extract_all(c, F.lit(r"(?i)(?:FROM|JOIN)\s+(\w+)"), 1)
    bad_table = F.get(F.filter(tables, lambda x: ~F.lower(x).isin(S.SQL_TABLES)), F.lit(0))
    dotted = F.regexp_extract_all(c, F.lit(r"([a-zA-Z_]\w*\.[a-zA-Z_]\w*)"), 1)
    bad_column = F.get(F.filter(dotted, lambda x: ~F.lower(F.substring_index(x, ".", -1)).isin(S.SQL_COLUMNS)), F.lit(0))
    word = F.regexp_extract(c, "(?i)" + S.SQL_FORBIDDEN, 1)
    limit = F.regexp_extract(c, r"(?i)LIMIT\s+(\d+)", 1)
    too_many = (limit != "") & (limit.cast("decimal(38,0)") > S.SQL_MAX_LIMIT)
    return log.withColumns({
        "structure": F.when(bad_table.isNotNull(), F.concat(F.lit("非法表名: "), bad_table)).when(
            bad_column.isNotNull(), F.concat(F.lit("非法列名: "), bad_column)).otherwise("OK"),
        "readonly": F.when(word != "", F.concat(F.lit("禁止的关键字: "), word)).otherwise("OK"),
        "resource": F.when(~F.upper(c).contains("LIMIT"), "缺少 LIMIT 子句").when(
            too_many, F.concat(F.lit("LIMIT 过大: "), limit, F.lit(" (>200)"))).otherwise("OK"),
    })
