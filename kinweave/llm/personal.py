"""Personal data by form, and by contexts that known forms teach.

Emails, addresses of machines, card and phone numbers are found by form. They are the seeds of a bootstrap. An instance is a seed or any
other run of characters that could be an identifier, in running prose as well as behind a label ("mail:", "passport no. ="). Its patterns
are the last one, two and three words before it, with their sign and without, and the first word after it. Patterns and values form a
graph: a pattern is as sure as the share of what stands beside it that is known, where ordinary words in its place count too, over all
texts ("the" stands before much else); a value is as sure as its surest pattern on either side, and both are scored in turn for ROUNDS rounds. A value that passes PROMOTED supports further patterns in the next round as a seed does. Patterns that
end sure enough, with enough different known or promoted values, discover further identifiers, reported as spans of kind `context`.

Everything is a DataFrame expression; patterns and values are counted before they are joined, and scores are joined from written tables,
so a pattern with any number of values can be split. Null is the empty text; empty tables and texts without instances give no further
spans. Equal texts are counted once. Texts are scanned whole, whatever their length. Spans count code points, the end is exclusive; spans of different kinds may overlap.
"""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.spans import named, with_matches, written_out
from kinweave.llm.tables import cut

#: Forms of the base kinds, written so that no text makes a match start twice in one run of characters or recurse per repetition.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
_IP_PARTS = rf"^{_PART}(?:\.{_PART}){{3}}$"

#: An identifier has at least five characters, one of them a digit, and ends where a piece of text ends.
IDENTIFIER = r"""(?<![^\s\p{Z}"'()<>\[\],;:=#])(?<![A-Za-z0-9+@._/#-]#)(?=[A-Za-z+@._/#-]*+[0-9])[A-Za-z0-9+@_][A-Za-z0-9+@._/#-]{4,}+(?![^\s\p{Z}"'()<>\[\],;:.!?])"""
#: Whatever a pattern may stand beside: the base forms, valid or not, and identifiers.
INSTANCE = "|".join((EMAIL, PHONE, CARD, IP, IDENTIFIER))
#: A label of one to three words, its sign, and the first piece of what stands behind it. Values that could be no identifier speak against it.
LABELLED = r"""(?<![\p{L}\p{M}])\p{L}[\p{L}\p{M}_.-]{1,24}(?:\x20\p{L}[\p{L}\p{M}_.-]{0,24}){0,2}\x20?[:=#]\x20{0,2}["'(<\[]{0,2}[^\s"'()<>\[\],;]{3,64}"""
_HEAD = r"""^[^:=#]+?[:=#]\x20{0,2}["'(<\[]{0,2}"""
_SIGNED = r"""[:=#]\x20{0,2}["'(<\[]{0,2}$"""
_WORD = r"[\p{L}\p{M}\p{N}_]+"
#: Code points of text beside an instance in which its words are sought, and words before it.
AROUND, WORDS = 160, 3

ROUNDS = 3
#: Unknown values that a pattern is taken to have beside those seen; confidence and different seeds that a pattern needs.
PRIOR, SURE, SUPPORT = 1.0, 0.6, 3
#: Score from which an unknown value supports patterns: more than two seeds behind one pattern give.
PROMOTED = 0.7


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Check of a number of at most 19 digits: from the right, every second digit counts twice, less 9 if above 9."""
    back = F.split(F.reverse(number), "")
    weighed = F.transform(back, lambda x, i: F.when(x == "", 0).when(i % 2 == 0, x.try_cast("int"))
                          .otherwise(x.try_cast("int") * 2 - F.when(x.try_cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(weighed, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows with an array of spans for each base kind, instances, labelled values, and a hash that equal texts share."""
    rows = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    rows = with_matches(rows, "_text", "email", EMAIL)
    rows = with_matches(rows, "_text", "ip", IP).withColumn("ip", F.filter("ip", lambda s: s["value"].rlike(_IP_PARTS)))
    count = lambda s: F.length(digits(s["value"]))
    rows = with_matches(rows, "_text", "card", CARD).withColumn("card", F.filter("card", lambda s: F.when(count(s) <= 19, luhn(digits(s["value"]))).otherwise(False)))
    rows = with_matches(rows, "_text", "phone", PHONE).withColumn("phone", F.filter("phone", lambda s: count(s).between(10, 15)))
    rows = with_matches(rows, "_text", "instance", INSTANCE, holds="[0-9@]", around=AROUND)
    rows = with_matches(rows, "_text", "labelled", LABELLED)
    return rows.withColumn("text_hash", F.sha2("_text", 256)).drop("_text")


def seed_of(value: Column) -> Column:
    """The base form in a value, null if there is none."""
    email, ip, card, phone = (F.regexp_extract(value, p, 0) for p in (EMAIL, IP, CARD, PHONE))
    n = F.length(digits(card))
    return F.coalesce(F.when(email != "", email), F.when(ip.rlike(_IP_PARTS), ip), F.when((n > 0) & (n <= 19), F.when(luhn(digits(card)), card)),
                      F.when(F.length(digits(phone)).between(10, 15), phone))


def patterns(before: Column, after: Column, words: int = WORDS) -> Column:
    """Patterns of different length, `*` being the place of the value: tails of the words before, with their sign and without, and the word after."""
    found = F.regexp_extract_all(F.lower(before), F.lit(_WORD), F.lit(0))
    # The first word of a full stretch may be a part of one.
    whole = F.when(F.length(before) < AROUND, found).otherwise(F.slice(found, 2, F.lit(AROUND)))
    n = F.least(F.size(whole), F.lit(words))
    tails = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda k: F.concat_ws(" ", F.slice(whole, -k, k)))).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    signed = F.when(before.rlike(_SIGNED), F.transform(tails, lambda t: F.concat(t, F.lit(" : *")))).otherwise(none)
    nxt = F.regexp_extract(F.lower(after), _WORD, 0)
    return F.concat(F.transform(tails, lambda t: F.concat(t, F.lit(" *"))), signed, F.when(nxt != "", F.array(F.concat(F.lit("* "), nxt))).otherwise(none))


def occurrences(rows: DataFrame) -> DataFrame:
    """(text_hash, label, value, start, end, known, shaped) of the instances of each text, one row for each of their patterns. A value is
    known if it holds a base form; it is then named by it. Labelled values that are not shaped as identifiers are not known."""
    head = lambda s: F.regexp_extract(s["value"], _HEAD, 0)
    kind = "array<struct<start:int,value:string,before:string,after:string,shaped:boolean>>"
    instances = F.transform("instance", lambda s: F.struct(s["start"].alias("start"), F.regexp_replace(s["value"], r"[.:!?/#_-]+$", "").alias("value"),
                                                           s["before"].alias("before"), s["after"].alias("after"), F.lit(True).alias("shaped")))
    named_only = F.transform("labelled", lambda s: F.struct((s["start"] + F.length(head(s))).alias("start"), F.regexp_replace(F.substr(s["value"], F.length(head(s)) + 1), r"[.:!?]+$", "").alias("value"),
                                                            head(s).alias("before"), F.lit("").alias("after"), F.lit(False).alias("shaped")))
    others = F.filter(named_only, lambda s: ~s["value"].rlike("[0-9@]"))
    one = rows.where(F.size("instance") + F.size("labelled") > 0).dropDuplicates(["text_hash"])
    each = one.select("text_hash", F.explode(F.concat(instances.cast(kind), others.cast(kind))).alias("s")).select("text_hash", "s.*").withColumn("seed", seed_of(F.col("value")))
    return each.where("seed IS NOT NULL OR NOT shaped OR length(value) >= 5").select(
        "text_hash", F.explode(patterns(F.col("before"), F.col("after"))).alias("label"), F.coalesce("seed", F.col("value")).alias("value"), "start",
        (F.col("start") + F.length("value")).cast("int").alias("end"), F.col("seed").isNotNull().alias("known"), "shaped")


def ordinary(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(of, n_all): how often the words of the wanted patterns without a sign stand in texts (column _text), instances taken out."""
    bare = F.when(F.col("_text").rlike("[0-9@]"), F.regexp_replace("_text", INSTANCE, " ")).otherwise(F.col("_text"))
    words = texts.select("_text").where("_text IS NOT NULL").distinct().select(F.regexp_extract_all(F.lower(bare), F.lit(_WORD), F.lit(0)).alias("_w"))
    back = lambda i, k: F.get("_w", i - k)
    each = F.transform("_w", lambda w, i: F.array(F.concat(w, F.lit(" *")), F.concat(F.lit("* "), w), F.concat(back(i, 1), F.lit(" "), w, F.lit(" *")),
                                                  F.concat(back(i, 2), F.lit(" "), back(i, 1), F.lit(" "), w, F.lit(" *"))))
    return words.select(F.explode(F.flatten(each)).alias("of")).join(wanted.select("label"), F.col("of") == F.col("label"), "left_semi").groupBy("of").agg(F.count("*").alias("n_all"))


def sure_labels(found: DataFrame, texts: DataFrame, rounds: int = ROUNDS, prior: float = PRIOR, sure: float = SURE, support: int = SUPPORT, promoted: float = PROMOTED) -> DataFrame:
    """(label, confidence): patterns that pass after the rounds. Each round joins scores over the distinct (label, value) pairs.

    Patterns with a single possible identifier never have the support of two values, so they leave first."""
    graph = cut(found.groupBy("label", "value").agg(F.max(F.col("known").cast("double")).alias("seed"), F.max("shaped").alias("shaped"), F.count("*").alias("n")), "personal-graph")
    seeds = cut(graph.groupBy("value").agg(F.max("seed").alias("score")), "personal-values")
    values = seeds
    wanted = cut(graph.groupBy("label").agg(F.count_if("shaped").alias("_v"), F.sum("n").alias("_n")).where("_v >= 2"), "personal-wanted")
    met = cut(ordinary(texts, wanted), "personal-ordinary")
    others = cut(wanted.join(met, F.col("label") == F.col("of"), "left").select(F.col("label").alias("_l"), F.greatest(F.lit(0), F.coalesce("n_all", F.lit(0)) - F.col("_n")).alias("others")), "personal-others")
    graph = cut(graph.join(others, F.col("label") == F.col("_l")).drop("_l"), "personal-patterns")
    for k in range(rounds):
        scored = graph.drop("seed").join(values, "value")
        labels = cut(scored.groupBy("label").agg((F.sum("score") / (F.count("*") + F.max("others") + F.lit(prior))).alias("confidence"),
                                                 F.sum((F.col("score") >= promoted).cast("int")).alias("seeds")), "personal-labels")
        if k + 1 < rounds:
            # Only patterns with support of their own speak for a value; tails of one context are no separate witnesses, so the surest of a side counts.
            after = F.col("label").startswith("* ")
            on = lambda c: F.coalesce(F.max(F.when(c, F.col("confidence"))), F.lit(0.0))
            told = graph.where("shaped").join(labels.where("seeds >= 2"), "label").groupBy(F.col("value").alias("of")).agg(
                (1 - (1 - on(~after)) * (1 - on(after))).alias("told"))
            values = cut(seeds.join(cut(told, "personal-told"), F.col("value") == F.col("of"), "left").select(
                "value", F.greatest("score", F.coalesce("told", F.lit(0.0))).alias("score")), "personal-values")
    return labels.where((F.col("confidence") >= sure) & (F.col("seeds") >= support)).select("label", "confidence")


def find_personal(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """key, counts of the base kinds, base spans and all spans (arrays of (start, rank, end, kind))."""
    rows = cut(scanned(docs.select(key, text), text).drop(text), "personal-rows")
    found = cut(occurrences(rows), "personal-occurrences")
    labels = cut(sure_labels(found, docs.select(F.col(text).alias("_text")), **settings), "personal-sure")
    rank = len(KINDS)
    new = (found.where(~F.col("known") & F.col("shaped")).join(labels, "label")
           .select("text_hash", "start", "end").distinct().groupBy(F.col("text_hash").alias("_hash")).agg(F.collect_list(F.struct("start", F.lit(rank).alias("rank"), "end", F.lit("context").alias("kind"))).alias("_new")))
    joined = rows.join(cut(new, "personal-new"), F.col("text_hash") == F.col("_hash"), "left")
    base = F.concat(*[named(F.col(k), k, i) for i, k in enumerate(KINDS)])
    kind = "array<struct<start:int,rank:int,end:int,kind:string>>"
    return joined.select(key, *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], base.alias("base"), F.concat(base, F.coalesce("_new", F.array().cast(kind))).alias("all"))


def report(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    return find_personal(docs, **settings).select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(written_out(F.col("base")), 256).alias("base_sha256"), written_out(F.col("all")).alias("spans"))
