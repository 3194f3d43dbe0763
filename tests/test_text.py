import pytest
from pyspark.sql import functions as F

from kinweave.plans import linking, questions as qs, statements as st
from tests.conftest import rows

COMPANIES = [("002594", "比亚迪"), ("300750", "宁德时代"), ("600519", "贵州茅台"), ("000858", "五粮液"), ("601318", "中国平安"), ("000001", "平安银行"),
             ("600036", "招商银行"), ("999001", "同名股份"), ("999002", "同名股份")]


@pytest.fixture(scope="module")
def company(spark):
    return spark.createDataFrame([(c, n, n + "股份有限公司") for c, n in COMPANIES], "stock_code string, short_name string, full_name string")


@pytest.fixture(scope="module")
def entity(spark):
    people = [(1, "person", "王传福"), (2, "person", "曾毓群"), (3, "org", "融捷投资控股集团有限公司"), (4, "person", "王传")]
    return spark.createDataFrame([(i, t, n, n, 0) for i, t, n in people],
                                 "entity_id bigint, entity_type string, canonical_name string, display_name string, is_channel int")


INTENTS = [
    ("002594的关联方有哪些", "Q1"), ("恒瑞医药的关联交易", "Q1"), ("002594和300750什么关系", "Q2"), ("比亚迪与宁德时代什么关系", "Q2"), ("茅台和五粮液的关系", "Q2"),
    ("王传福控制哪些公司", "Q3"), ("中国平安持股超过5%的公司", "Q3"), ("李振国担任什么职务", "Q3"), ("002594的前十大股东", "Q4"), ("600519的基本信息", "Q4"),
    ("300750的诉讼", "Q5"), ("600519的法律纠纷", "Q5"), ("比亚迪和宁德时代有哪些共同关联方", "Q6"), ("茅台的利润增长趋势", "Q7"), ("对比比亚迪和宁德时代", "Q8"),
    ("关联方重合", "Q6"), ("实控人是谁", "Q4")]


def test_intents(spark):
    df = spark.createDataFrame(INTENTS, "text string, want string").withColumn("got", qs.intent(F.col("text"))["intent"])
    assert [(r["text"], r["got"]) for r in df.collect()] == INTENTS


SLOTS = [
    ("Q1", "比亚迪的关联方", None, {"company": "002594"}), ("Q1", "茅台的关联方清单", "600519", {"company": "600519"}), ("Q1", "关联方", "600036", {"company": "600036"}),
    ("Q1", "关联方", None, {"company": None, "filled": 0}), ("Q1", "同名股份的关联方", None, {"company": "", "clarify": 1}),
    ("Q2", "002594和300750什么关系", None, {"entity_a": "002594", "entity_b": "300750"}), ("Q2", "宁德时代和比亚迪什么关系", None, {"entity_a": "300750", "entity_b": "002594"}),
    ("Q2", "王传福和曾毓群什么关系", None, {"entity_a": "王传福", "entity_b": "曾毓群"}), ("Q3", "王传福控制哪些公司", None, {"entity": "1", "relation_type": "control"}),
    ("Q4", "比亚迪的实际控制人是谁", None, {"company": "002594", "role_type": "controller"}), ("Q4", "300750的董监高", None, {"company": "300750", "role_type": "all"}),
    ("Q5", "担保情况和诉讼", "002594", {"company": "002594", "event_types": "guarantee,lawsuit"}),
    ("Q6", "贵州茅台和五粮液的关联方交集", None, {"company_a": "600519", "company_b": "000858"}), ("Q6", "002594和300750的关联方重合", None, {"company_a": "002594", "company_b": "300750"})]


def test_slots(spark, company, entity):
    df = spark.createDataFrame([(i, q, n, c) for i, (n, q, c, _) in enumerate(SLOTS)], "id bigint, text string, intent string, context_code string")
    got = {r["id"]: r.asDict() for r in qs.slots(df, company, entity).collect()}
    for i, (_, q, _, want) in enumerate(SLOTS):
        assert {k: got[i][k] for k in want} == want, q


def test_matches(spark, company):
    df = spark.createDataFrame([(1, "茅台与平安银行、比亚迪"), (2, "000001和20251231"), (3, "无")], "id bigint, text string")
    assert rows(linking.company_match(df, company), "id", "code") == [(1, "000001"), (2, "000001")]
    assert rows(linking.first_two_matches(df, company), "id", "code_1", "code_2") == [(1, "600519", "000001"), (2, "000001", None)]


def test_occurrences_against_search(spark, monkeypatch):
    words = ["ab", "abc", "b.c", "汉字", "cab"]
    texts = [(1, "abcabc b.c汉字"), (2, "cab.cabb"), (3, ""), (4, "x")]
    w = spark.createDataFrame([(x,) for x in words], "word string")
    want = sorted((i, p + 1, x) for i, t in texts for x in words for p in range(len(t)) if t.startswith(x, p))
    t = spark.createDataFrame(texts, "id bigint, text string")
    assert sorted(tuple(r) for r in linking.occurrences(t, w).select("id", "pos", "word").collect()) == want
    # Many heads, words of one character, words longer than a piece of text, and pieces that cut words.
    monkeypatch.setattr(linking, "PIECE", 3)
    words = [*words, *[chr(0x4E00 + i) + chr(0x4F00 + i) for i in range(200)], "x", "abcabc b.c汉", "一伀"]
    texts = [*texts, (5, "一伀x" * 40 + "丁企"), (6, "abcabc b.c汉字" * 3)]
    want = sorted({(i, p + 1, x) for i, t in texts for x in set(words) for p in range(len(t)) if t.startswith(x, p)})
    w = spark.createDataFrame([(x,) for x in sorted(set(words))], "word string")
    t = spark.createDataFrame(texts, "id bigint, text string")
    assert sorted(tuple(r) for r in linking.occurrences(t, w).select("id", "pos", "word").collect()) == want


def test_references(spark):
    q = spark.createDataFrame([
        (1, "a", 1, "比亚迪的关联方", 1), (2, "a", 2, "它的担保呢", 0), (3, "a", 3, "最后一个呢", 0), (4, "a", 4, "第九个呢", 0), (5, "a", 5, "诉讼呢", 0),
        (6, "b", 1, "它呢", 0), (7, "c", 3, "它呢", 0)], "id bigint, session string, turn int, text string, has_entity int")
    m = spark.createDataFrame([("a", 1, 0, "002594", "比亚迪"), ("c", 1, 0, "002594", "比亚迪"), ("c", 2, 0, "300750", "宁德时代")], "session string, turn int, ord int, code string, name string")
    r = spark.createDataFrame([("a", 2, 0, "X", "甲"), ("a", 2, 1, "Y", "乙")], "session string, turn int, pos int, code string, name string")
    got = {x["id"]: (x["kind"], x["target"], x["clarify"]) for x in qs.references(q, m, r).collect()}
    assert got == {1: ("none", None, 0), 2: ("pronoun", "002594", 0), 3: ("ordinal", "Y", 0), 4: ("ordinal", None, 1), 5: ("omission", "002594", 0),
                   6: ("pronoun", None, 1), 7: ("pronoun", None, 1)}


GUARD = [
    ("SELECT * FROM company LIMIT 10", "OK", "OK", "OK"), ("SELECT * FROM evil_table LIMIT 10", "非法表名: evil_table", "OK", "OK"),
    ("SELECT e.password FROM entity e LIMIT 10", "非法列名: e.password", "OK", "OK"), ("delete from company", "OK", "禁止的关键字: delete", "缺少 LIMIT 子句"),
    ("select * from COMPANY limit 10", "OK", "OK", "OK"), ("SELECT * FROM company LIMIT 201", "OK", "OK", "LIMIT 过大: 201 (>200)"),
    ("SELECT * FROM company LIMIT 200", "OK", "OK", "OK"), ("SELECT * FROM company -- DROP TABLE entity\n LIMIT 10", "OK", "禁止的关键字: DROP", "OK")]


def test_sql_audit(spark):
    df = qs.audit_sql(spark.createDataFrame([(g[0],) for g in GUARD], "sql string"))
    assert [tuple(r) for r in df.select("sql", "structure", "readonly", "resource").collect()] == GUARD


def test_statements(spark, company, entity):
    s = spark.createDataFrame([
        (1, "王传福持有比亚迪49%的股份"), (2, "王传福持有比亚迪39.28%的股份"), (3, "002594有12笔担保,金额63864300元"), (4, "由虚构新能源科技有限公司持有"),
        (5, "融捷投资控股集团有限公司持有"), (6, "代码123456"), (7, "比亚迪更稳健")], "id bigint, text string")
    allowed = spark.createDataFrame([(1, "percent", 39.28, None), (2, "percent", 39.28, None), (3, "count", None, "12"), (3, "amount", 63864300.0, None)],
                                    "id bigint, kind string, number double, value string")
    named = spark.createDataFrame([(5, "融捷投资控股集团有限公司")], "id bigint, name string")
    got = {r["id"]: r["passed"] for r in st.verdicts(s, company, entity, allowed, result_names=named).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 0, 5: 1, 6: 0, 7: 0}


def test_link_levels(spark, company):
    t = spark.createDataFrame([("002594",), ("比亚迪",), ("同名股份",), ("比亚迪股份有限公司",), ("平安",), ("银行",), ("无此",), ("比 亚迪",)], "text string")
    got = {r["text"]: (r["method"], r["code"], r["clarify"]) for r in linking.link_company(t, company).collect()}
    assert got["002594"] == ("exact_code", "002594", 0) and got["比亚迪"] == ("short_name_exact", "002594", 0)
    assert got["同名股份"] == ("short_name_ambiguous", None, 1) and got["比亚迪股份有限公司"][0] == "full_name_exact"
    assert got["平安"] == ("fuzzy", None, 1) and got["无此"] == ("not_found", None, 0) and got["比 亚迪"] == ("normalized", "002594", 0)


def test_occurrences_with_many_heads(spark):
    """50,000 words with as many heads: every place and nothing else, words over the edges of pieces, a piece long ones, an empty dictionary."""
    import random

    from kinweave.plans import linking
    rng = random.Random(6)
    char = lambda: chr(0x4E00 + rng.randrange(1500))
    known = {char() + char() + "".join(char() for _ in range(rng.randrange(3))) for _ in range(50_000)} | {"甲" * 300, "甲乙"}
    texts = ["".join(char() for _ in range(n)) for n in (0, 1, 2, 255, 256, 257, 700)] + ["x" * 250 + "甲" * 300 + "乙" + "y" * 300, "甲乙" * 300, None]
    lengths = sorted({len(w) for w in known})
    want = {(i, p + 1, t[p:p + k]) for i, t in enumerate(texts) if t for p in range(len(t)) for k in lengths if t[p:p + k] in known and p + k <= len(t)}
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    words = spark.createDataFrame([(w,) for w in known], "word string")
    assert {tuple(r) for r in linking.occurrences(df, words).select("id", "pos", "word").collect()} == want and len(want) > 300
    one = linking.occurrences(df, spark.createDataFrame([("甲",), ("甲乙",)], "word string"))
    assert one.where("id = 8").groupBy("word").count().collect() and one.where("id = 8 AND word = '甲'").count() == 300
    assert linking.occurrences(df, words.limit(0)).count() == 0


def test_large_sides_of_links_are_not_broadcast(spark, monkeypatch):
    """Names pack so well that the size of their file or shuffle says little of what they take in the driver's memory."""
    monkeypatch.setattr(linking, "SHUFFLED_WORDS", 1)
    company = spark.createDataFrame([("000001", "Alpha"), ("000002", "Beta")], "stock_code string, short_name string")
    entity = spark.createDataFrame([(1, "Alpha", "alpha", 0), (2, "Beta Fund", "beta fund", 0), (3, "Gamma", "gamma", 0)],
                                   "entity_id bigint, display_name string, canonical_name string, is_channel int")
    holding = spark.createDataFrame([(2, "000001")], "entity_id bigint, stock_code string")
    texts = spark.createDataFrame([("Alpha",), ("Beta",), ("GAMMA",), ("amm",), ("none",)], "text string")
    linked = linking.link_entity(texts, company, entity, holding)
    assert {r.text: (r.method, r.entity_id, r.candidates) for r in linked.collect()} == {
        "Alpha": ("company_name->entity", 1, None), "Beta": ("company_fuzzy+hold_count", 2, None), "GAMMA": ("display_name_exact", 3, None),
        "amm": ("fuzzy", None, "3"), "none": ("not_found", None, None)}
    plan = linked._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan
    assert not [line for line in plan.splitlines() if "Join [t#" in line and "LeftOuter" in line], "parts of a text meet in a grouping"
