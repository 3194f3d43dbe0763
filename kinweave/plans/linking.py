"""Names in texts linked to companies and entities.

A dictionary name inside a text is found by two equi-joins: the places of the text at which a name may begin with the first characters of
names, and there one substring per length such names have with the names. No text meets every name.
"""
from pyspark.sql import DataFrame, functions as F

from kinweave.functions import names
from kinweave.functions.text import exploded
from kinweave.operators import summaries
from kinweave.session import written

#: Characters of a text that are one row before its places are, and slots of the table of heads.
PIECE, SLOTS = 256, 1 << 18
#: A dictionary with more words than this is shuffled to the places of the texts, however small its file is.
SHUFFLED_WORDS = 100_000


def company_dictionary(company) -> DataFrame:
    """Spellings of companies: short and full names, and aliases that are nobody's name. Columns: word, code."""
    own = company.select("stock_code", F.explode(F.array_compact(F.array("short_name", "full_name"))).alias("n")).select(
        names.matcher_norm("n").alias("word"), F.col("stock_code").alias("code")).where("char_length(word) >= 2").distinct()
    alias = company.select(names.matcher_norm(names.derive_alias("short_name")).alias("word"), F.col("stock_code").alias("code")).where(
        "char_length(word) >= 2").distinct()
    return own.unionAll(alias.join(own.select("word"), "word", "left_anti"))


def person_dictionary(entity) -> DataFrame:
    live = entity.where("entity_type = 'person' AND is_channel = 0 AND display_name IS NOT NULL")
    return live.select(names.matcher_norm("display_name").alias("word"), F.col("entity_id").alias("code")).where(
        "char_length(word) >= 2").distinct()


def words(dictionary) -> DataFrame:
    """One row per spelling: how many it may stand for, and the first of them."""
    return dictionary.groupBy("word").agg(F.count("*").alias("n_codes"), F.min("code").alias("code"))


def _heads(word_rows):
    """(length of a head, length of the longest word, slots of the heads' hashes, number of rows) of a dictionary; None without words.

    Two characters are a head, one if there are words of one. The slots are one byte each, so what is told of the heads has a fixed size.
    """
    least, most, n_rows = word_rows.agg(F.min(F.char_length("word")), F.max(F.char_length("word")), F.count("*")).first()
    if not least:
        return None
    head, slots = min(2, least), bytearray(SLOTS)
    for r in word_rows.select(_slot(F.left("word", F.lit(head))).alias("s")).distinct().collect():
        slots[r.s] = 1
    return head, most, bytes(slots), n_rows


def _slot(c):
    return F.pmod(F.xxhash64(c), F.lit(SLOTS)).cast("int")


def occurrences(texts, word_rows, key="id", text="text") -> DataFrame:
    """Every place where a word occurs. texts: key, text (already in the words' spelling). Adds pos (1-based) and len.

    A text becomes pieces of PIECE characters, each with as much of what follows as the longest word needs. The places of a piece at which
    no word begins are left out inside the row, by a table of fixed size of the hashes of the words' first characters; only the
    others become rows. They are joined with the heads of the words, which say how long a word that begins so can be, a substring is cut for
    each length, and that is joined with the words. No text meets every word, whatever the size of the dictionary.
    """
    # Asked for several times below, and spelled out once.
    word_rows = written(word_rows, "words")
    shape = _heads(word_rows)
    if shape is None:
        none = texts.where("false").select(key, F.lit(1).alias("pos"), F.lit(1).alias("len"), F.lit("").alias("word"))
        return none.join(word_rows, "word")
    head, most, slots, n_rows = shape
    heads = word_rows.groupBy(F.left("word", F.lit(head)).alias("head")).agg(F.collect_set(F.char_length("word")).alias("lens"))
    chunks = F.regexp_extract_all(text, F.lit(r"(?s).{1,%d}" % PIECE), F.lit(0))
    rows = texts.select(key, chunks.alias("_chunks"))
    # Words longer than a piece need more than one piece after their own.
    ahead = F.array_join(F.slice("_chunks", F.col("_i") + 2, F.lit(-(-most // PIECE))), "")
    # The outer form: filters inferred for the other one would work out the text and its pieces again.
    pieces = rows.select("*", F.posexplode_outer("_chunks").alias("_i", "_piece")).where("_piece IS NOT NULL").select(
        key, "_i", F.char_length("_piece").alias("_n"), F.concat("_piece", F.left(ahead, F.lit(most - 1))).alias("_text"))
    table, one = F.lit(slots), F.lit(b"\x01")
    begins = F.filter(F.sequence(F.lit(1), F.col("_n")), lambda p: F.substring(table, _slot(F.substring(F.col("_text"), p, F.lit(head))) + 1, F.lit(1)) == one)
    place = F.col("_p")
    placed = exploded(pieces, [key, "_i", "_text"], begins, "_p").select(
        key, (F.col("_i") * PIECE + place).alias("pos"), F.substring("_text", place, F.lit(head)).alias("head"),
        F.substring("_text", place, F.lit(most)).alias("_rest"))
    met = placed.join(heads, "head")
    cuts = exploded(met, [key, "pos", "_rest"], F.filter("lens", lambda k: k <= F.char_length("_rest")), "len").select(
        key, "pos", "len", F.left("_rest", F.col("len")).alias("word"))
    # Names pack well: a file of ten megabytes, which would be broadcast, can be some hundred in the driver's memory.
    return cuts.join(word_rows.hint("merge") if n_rows > SHUFFLED_WORDS else word_rows, "word")


def _normed(texts, key, text):
    return texts.select(key, names.matcher_norm(text).alias("_norm"))


def _longest(hits, key):
    best = hits.groupBy(key).agg(F.min_by(F.struct("word", "n_codes", "code"), F.struct(-F.col("len"), F.col("pos"))).alias("m"))
    return best.select(key, F.col("m.word").alias("word"), F.col("m.n_codes").alias("n_codes"),
                       F.when(F.col("m.n_codes") == 1, F.col("m.code")).alias("code"))


def dictionary_hits(texts, dictionary, key="id", text="text") -> DataFrame:
    """Occurrences of a dictionary's words in texts as they are written."""
    return occurrences(_normed(texts, key, text), words(dictionary), key, "_norm").select("word", key, "pos", "len", "n_codes", "code")


def longest_match(texts, dictionary, key="id", text="text") -> DataFrame:
    """Longest word of each text (the leftmost of equally long ones): word, n_codes, code (null when ambiguous)."""
    return _longest(dictionary_hits(texts, dictionary, key, text), key)


def company_match(texts, company, key="id", text="text", hits=None) -> DataFrame:
    """A known six-digit code first, else the longest dictionary word; several companies behind it make it ambiguous."""
    if hits is None:
        hits = dictionary_hits(texts, company_dictionary(company), key, text)
    stated = texts.select(key, F.regexp_extract(text, r"(?<!\d)(\d{6})(?!\d)", 1).alias("stock_code")).where("stock_code <> ''")
    by_code = stated.join(company.select("stock_code"), "stock_code", "left_semi").select(
        key, F.col("stock_code").alias("word"), F.lit(1).cast("bigint").alias("n_codes"), F.col("stock_code").alias("code"),
        F.lit("code_exact").alias("method"))
    kind = F.when(F.col("n_codes") > 1, "dict_ambiguous").when(F.char_length("word") <= 8, "dict_short_name").otherwise("dict_full_name")
    return by_code.unionAll(_longest(hits, key).join(by_code.select(key), key, "left_anti").select(
        key, "word", "n_codes", "code", kind.alias("method")))


def code_places(texts, company, key, text) -> DataFrame:
    """First place of every known six-digit code that is no part of a longer number."""
    marker = "\u0001"
    pattern = r"(?<!\d)(\d{6})(?!\d)"
    marked = F.regexp_replace(text, pattern, marker + "$1")
    rows = texts.where(F.col(text).rlike(r"\d{6}")).select(
        key, marked.alias("_m"), F.regexp_extract_all(text, F.lit(pattern), 1).alias("_c"))
    rows = rows.select(key, "_m", "_c", F.explode(F.array_distinct("_c")).alias("word"))
    placed = rows.select(key, (F.instr("_m", F.concat(F.lit(marker), "word")) - F.array_position("_c", F.col("word")) + 1).cast("int").alias("pos"),
                         F.lit(6).alias("len"), "word")
    return placed.join(company.select(F.col("stock_code").alias("word")), "word", "left_semi").select(
        "word", key, "pos", "len", F.lit(1).cast("bigint").alias("n_codes"), F.col("word").alias("code"))


def first_two_matches(texts, company, key="id", text="text", hits=None) -> DataFrame:
    """The first two codes or words from the left that do not overlap, the longer one where two start together."""
    if hits is None:
        hits = dictionary_hits(texts, company_dictionary(company), key, text)
    hits = hits.unionByName(code_places(_normed(texts, key, text), company, key, "_norm"))
    item, order = F.struct("pos", "len", "word", "n_codes", "code"), F.struct(F.col("pos"), -F.col("len"))
    first = hits.groupBy(key).agg(F.min_by(item, order).alias("a"))
    later = hits.join(first.select(key, (F.col("a.pos") + F.col("a.len")).alias("_end")), key).where("pos >= _end")
    second = later.groupBy(key).agg(F.min_by(item, order).alias("b"))
    return first.join(second, key, "left").select(
        key, F.col("a.word").alias("word_1"), F.col("a.n_codes").alias("n_codes_1"), F.col("a.code").alias("code_1"),
        F.col("b.word").alias("word_2"), F.col("b.n_codes").alias("n_codes_2"), F.col("b.code").alias("code_2"))


def person_match(texts, entity, key="id", text="text") -> DataFrame:
    return longest_match(texts, person_dictionary(entity), key, text)


def first_two_persons(texts, entity, key="id", text="text") -> DataFrame:
    """The longest person name and the longest other one beside its first place."""
    hits = occurrences(_normed(texts, key, text), words(person_dictionary(entity)), key, "_norm")
    item, order = F.struct("pos", "len", "word", "n_codes", "code"), F.struct(-F.col("len"), F.col("pos"))
    first = hits.groupBy(key).agg(F.min_by(item, order).alias("a"))
    rest = hits.join(first.select(key, F.col("a.word").alias("_w"), F.col("a.pos").alias("_s"), (F.col("a.pos") + F.col("a.len")).alias("_e")), key)
    rest = rest.where("word <> _w AND (pos >= _e OR pos + len <= _s)")
    second = rest.groupBy(key).agg(F.min_by(item, order).alias("b"))
    return first.join(second, key, "left").select(
        key, F.col("a.word").alias("person_1"), F.col("a.n_codes").alias("n_1"), F.col("a.code").alias("entity_1"),
        F.col("b.word").alias("person_2"))


def _counted(df, key, name):
    return df.groupBy(key).agg(F.count("*").alias(f"n_{name}"), F.min("code").alias(f"c_{name}"))


def _contained(wanted, holders, text_col, code_col):
    """For each wanted text (column t): how many rows of holders contain it, at most five of them as candidates."""
    word_rows = wanted.select(F.lower("t").alias("word")).where("word <> ''").distinct()
    texts = holders.select(F.col(code_col).alias("id"), F.lower(text_col).alias("text")).distinct()
    hits = occurrences(texts, word_rows).select("word", "id").distinct()
    first = summaries.first_per_key(hits, ["word"], ["id"], 5).groupBy("word").agg(F.array_join(F.transform(F.array_sort(
        F.collect_list("id")), lambda x: x.cast("string")), ",").alias("like_codes"))
    # All are counted, five are shown. Both sides lie by word already.
    return hits.groupBy("word").agg(F.count("*").alias("n_like")).join(first.hint("merge"), "word")


def link_company(texts, company) -> DataFrame:
    """Company of each distinct text: code, short name (several are ambiguous), full name, normalised, contained. texts: text."""
    t = texts.select(F.trim("text").alias("t")).distinct()
    c = company.select(F.col("stock_code").alias("code"), "short_name", "full_name")
    n = names.normalize_name("t")
    by_code = t.where(F.col("t").rlike(r"^\d{6}$")).join(c, F.col("t") == F.col("code"), "left_semi").select("t", F.col("t").alias("c_code"))
    short = _counted(t.join(c, F.col("t") == F.col("short_name")), "t", "short")
    full = _counted(t.join(c, F.col("t") == F.col("full_name")), "t", "full")
    norm = _counted(t.select("t", F.lower(n).alias("k")).join(c.select("code", F.lower("short_name").alias("k")), "k"), "t", "norm")
    like = _contained(t, company, "short_name", "stock_code")
    rows = (t.join(by_code, "t", "left").join(short, "t", "left").join(full, "t", "left").join(norm, "t", "left")
            .withColumn("word", F.lower("t")).join(like, "word", "left"))
    level = (F.when(F.col("c_code").isNotNull(), "exact_code").when(F.col("n_short") == 1, "short_name_exact")
             .when(F.col("n_short") > 1, "short_name_ambiguous").when(F.col("n_full") == 1, "full_name_exact")
             .when(F.col("n_norm") == 1, "normalized").when(F.col("n_like") > 0, "fuzzy").otherwise("not_found"))
    rows = rows.withColumn("method", level)
    m = F.col("method")
    return rows.select(
        F.col("t").alias("text"), "method", F.when(m == "exact_code", F.col("c_code")).when(m == "short_name_exact", F.col("c_short"))
        .when(m == "full_name_exact", F.col("c_full")).when(m == "normalized", F.col("c_norm")).alias("code"),
        F.when(m == "fuzzy", F.col("like_codes")).alias("candidates"),
        ((m == "short_name_ambiguous") | ((m == "fuzzy") & (F.col("n_like") > 1))).cast("int").alias("clarify"))


def link_entity(texts, company, entity, holding) -> DataFrame:
    """Entity of each distinct text: over the company of that name, by display name, by key, contained. texts: text."""
    t = texts.select(F.trim("text").alias("t")).distinct()
    live = entity.where("is_channel = 0").select(F.col("entity_id").alias("code"), "display_name", "canonical_name")
    # What has a row per text or entity is never broadcast: names pack so well that their shuffled size tells little of their size in memory.
    co = t.select("t", F.lower("t").alias("k")).join(company.select("short_name", F.lower("short_name").alias("k")).hint("merge"), "k").groupBy("t").agg(
        F.count("*").alias("n"), F.min("short_name").alias("cname")).where("n = 1").select("t", "cname")
    by_name = live.select("code", F.lower("display_name").alias("k"))
    via = _counted(co.select("t", F.lower("cname").alias("k")).join(by_name.hint("merge"), "k"), "t", "via")
    prefix = summaries.prefix_match(co.join(via, "t", "left_anti").select(F.col("cname").alias("name")), entity, holding)
    pre = co.join(prefix.select(F.col("name").alias("cname"), F.col("entity_id").alias("c_pre")), "cname").select("t", "c_pre")
    disp = _counted(t.select("t", F.lower("t").alias("k")).join(by_name.hint("merge"), "k"), "t", "disp")
    n = names.normalize_name("t")
    keys = t.select("t", F.posexplode(F.array(n, names.org_key_of_normalized(n), F.col("t"))).alias("o", "k")).where("k <> ''")
    canon = live.groupBy(F.lower("canonical_name").alias("k")).agg(F.count("*").alias("n"), F.min("code").alias("code")).where("n = 1")
    key = keys.withColumn("k", F.lower("k")).join(canon.hint("merge"), "k").groupBy("t").agg(F.min_by("code", "o").alias("c_key"))
    like = t.withColumn("word", F.lower("t")).join(
        _contained(t, entity.where("is_channel = 0"), "display_name", "entity_id").hint("merge"), "word").drop("word")
    # Each part has one row per text at most; they meet in one grouping, so that no part has to fit into anyone's memory.
    rows = t
    for part in (via, pre, disp, key, like):
        rows = rows.unionByName(part, allowMissingColumns=True)
    rows = rows.groupBy("t").agg(*[F.max(c).alias(c) for c in rows.columns if c != "t"])
    level = (F.when(F.col("n_via") >= 1, "company_name->entity").when(F.col("c_pre").isNotNull(), "company_fuzzy+hold_count")
             .when(F.col("n_disp") == 1, "display_name_exact").when(F.col("n_disp") > 1, "ambiguous")
             .when(F.col("c_key").isNotNull(), "normalized").when(F.col("n_like") > 0, "fuzzy").otherwise("not_found"))
    rows = rows.withColumn("method", level)
    m = F.col("method")
    return rows.select(
        F.col("t").alias("text"), "method",
        F.when(m == "company_name->entity", F.col("c_via")).when(m == "company_fuzzy+hold_count", F.col("c_pre"))
        .when(m == "display_name_exact", F.col("c_disp")).when(m == "normalized", F.col("c_key")).alias("entity_id"),
        F.when(m == "fuzzy", F.col("like_codes")).alias("candidates"),
        ((m == "ambiguous") | ((m == "fuzzy") & (F.col("n_like") > 1))).cast("int").alias("clarify"))
