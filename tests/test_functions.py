import pytest
from pyspark.sql import functions as F

from kinweave import settings as S
from kinweave.functions import codes, names, paths, text
from kinweave.plans.evaluation import scope_class


def one(spark, expr, value, typ="string"):
    return spark.createDataFrame([(value,)], f"x {typ}").select(expr(F.col("x"))).first()[0]


@pytest.mark.parametrize("raw,want", [
    ("１２３ＡＢＣ", "123ABC"), ("　中国　", "中国"), ("  中国 工商 \n银行 \t", "中国工商银行"), ("A－B", "A-B"), ("A—B", "A-B"), ("A–B", "A-B"),
    ("", ""), (None, ""), ("中国工商银行股份有限公司", "中国工商银行股份有限公司"), ("a b", "ab"), ("①号", "1号")])
def test_normalize(spark, raw, want):
    assert one(spark, names.normalize_name, raw) == want


def test_exact_normalization_of_expanding_characters(spark):
    df = spark.createDataFrame([(1, "㈱日立"), (2, "ｶﾞ"), (3, "Ａ Ｂ"), (4, None), (5, "e\u0323\u0302"), (6, "\U0001d400"), (7, "각")], "id int, x string")
    got = {r["id"]: r["n"] for r in names.with_normalized(df, "x", "n").collect()}
    assert got == {1: "(株)日立", 2: "ガ", 3: "AB", 4: "", 5: "ệ", 6: "A", 7: "각"}


def test_every_sign_has_its_plain_form(spark):
    """All signs of the basic plane between two letters, against the standard library."""
    import re
    import unicodedata
    dash = re.compile(r"[\u2010-\u2015\u2212\uff0d]")
    signs = [chr(p) for p in range(0x20, 0x10000) if not 0xD800 <= p < 0xE000]
    df = spark.createDataFrame([(x, f"甲{x}乙{x}") for x in signs], "x string, name string")
    plain = lambda s: re.sub(r"\s+", "", dash.sub("-", unicodedata.normalize("NFKC", dash.sub("-", s))))
    got = {r["x"]: (r["n"], r["e"]) for r in names.with_normalized(df.withColumn("n", names.normalize_name("name")), "name", "e").collect()}
    joining = re.compile(names._joining().split("\\x{")[0].encode().decode("unicode_escape") + "]")
    assert [x for x in signs if not joining.search(x) and got[x][0] != plain(f"甲{x}乙{x}")] == []
    assert [x for x in signs if got[x][1] != plain(f"甲{x}乙{x}")] == []


@pytest.mark.parametrize("raw,key", [("㈱日立有限公司", "(株)日立"), ("㍿甲股份有限公司", "株式会社甲"), ("甲㏄乙", "甲cc乙"), ("㊤—㈱", "上-(株)")])
def test_signs_with_several_plain_signs(spark, raw, key):
    assert one(spark, names.org_match_key, raw) == key
    assert one(spark, names.matcher_norm, "㈱日立A") == "(株)日立"


@pytest.mark.parametrize("raw,want", [
    ("中国工商银行股份有限公司", "中国工商银行"), ("XX有限公司", "XX"), ("XX有限责任公司", "XX"), ("XXX集团有限公司", "XXX"), ("XX集团", "XX"),
    ("中国工商银行", "中国工商银行"), ("公司", "公司"), ("甲集团股份有限公司总公司", "甲")])
def test_org_key(spark, raw, want):
    assert one(spark, names.org_match_key, raw) == want


@pytest.mark.parametrize("raw,manager,key", [
    ("招商银行股份有限公司-南方中证1000交易型开放式指数证券投资基金", "南方", "FUND:南方"),
    ("中国工商银行股份有限公司-华泰柏瑞沪深300交易型开放式指数证券投资基金", "华泰柏瑞", "FUND:华泰柏瑞"),
    ("中国农业银行股份有限公司-易方达基金管理有限公司", "易方达", "FUND:易方达"), ("某未知基金-某某1号产品", None, "CUST:某未知基金"),
    ("国泰君安", "国泰", "FUND:国泰"), ("-甲有限公司", None, "CUST:-甲")])
def test_funds(spark, raw, manager, key):
    assert one(spark, names.fund_manager, raw) == manager
    assert one(spark, names.fund_match_key, raw) == key


@pytest.mark.parametrize("raw,want", [
    ("国务院国有资产监督管理委员会", True), ("深圳市国有资产监督管理局", True), ("河南省财政厅", True), ("广州市人民政府", True),
    ("中国证券监督管理委员会", True), ("国务院", True), ("中央汇金资产管理有限责任公司", True), ("中国电子信息产业集团有限公司", False),
    ("国家开发投资集团有限公司", False), ("深圳市投资控股有限公司", False), ("招商局集团有限公司", False), ("华润集团有限公司", False), ("王传福", False),
    ("", False), (None, False)])
def test_channels(spark, raw, want):
    assert one(spark, names.is_channel_name, raw) is want


@pytest.mark.parametrize("name,desc,want", [
    ("王传福", "公司第一大股东、董事长", "upstream"), ("吕向阳", "持有5%以上股份的股东", "upstream"), ("曾毓群", "实际控制人", "upstream"),
    ("厦门瑞庭投资有限公司", "控股股东", "upstream"), ("成都电服交投能源科技有限公司", "合营企业", "downstream"), ("Autoflightx Inc", "联营企业", "downstream"),
    ("XX公司", "本公司母公司的控股子公司", "downstream"), ("某基金有限公司", "", "other"), ("ABC Holdings Ltd", "", "other"),
    ("XX部分子公司", "", "downstream"), ("张伟", "", "upstream"), ("XX", "控股股东的子公司", "downstream"), ("张伟", "其他", "other")])
def test_scope(spark, name, desc, want):
    df = spark.createDataFrame([(name, desc)], "n string, d string")
    assert df.select(scope_class(F.col("n"), F.col("d"))).first()[0] == want


def test_titles_and_types(spark):
    t = lambda x: one(spark, names.title_class, x)
    assert [t(x) for x in ("独立董事", "监事会主席", "董事会秘书", "副总经理", "职工", "董秘")] == [
        "independent_director", "supervisor", "director", "senior_mgmt", "other", "senior_mgmt"]
    df = spark.createDataFrame([("境内自然人", "甲公司"), ("", "张三"), ("其他", "张三基金"), ("私募基金", "x")], "t string, n string")
    assert [r[0] for r in df.select(names.holder_entity_type("t", "n")).collect()] == ["person", "person", "org", "fund"]


@pytest.mark.parametrize("raw,want", [
    ("20260630", "2026-06-30"), ("2026-06-30 00:00", "2026-06-30"), ("2026Q2", "2026-06-30"), ("2026q4", "2026-12-31"), ("年报", "年报"), (None, None)])
def test_period(spark, raw, want):
    assert one(spark, codes.normalize_period, raw) == want


def test_codes_and_numbers(spark):
    assert one(spark, codes.strip_code_prefix, "SH600036") == "600036"
    assert one(spark, codes.strip_code_prefix, "1234567") == "1234567"
    assert one(spark, codes.exchange_code, "688001") == "sh688001"
    assert one(spark, codes.safe_double, "nan") is None and one(spark, codes.safe_int, "3.9") == 3
    assert one(spark, text.extract_codes, "20251231和600036、12345678") == ["600036"]


def test_values_and_wording(spark):
    assert one(spark, text.extract_dates, "2024年3月5日和2023/11，2022-1-9") == ["2024-03-05", "2023-11", "2022-01-09"]
    assert one(spark, text.extract_amounts, "1,234.5万元与3亿") == ["1,234.5|万元", "3|亿"]
    assert [h["kind"] for h in one(spark, text.wording_hits, "更稳健，建议买入关注，说明向好")] == ["评价性表述", "评价性表述", "投资倾向", "因果推断"]
    assert one(spark, text.redact, "key sk-abcdefghijk1 Bearer abcdefghij12 API_KEY=xyz") == "key sk-*** Bearer *** api_key=***"


def test_paths(spark):
    df = spark.range(1).select(F.array(
        paths.make_hop("张三", "000001", "HOLDS", ratio=F.lit(5.5), rank=F.lit(None)), paths.make_hop("000001", "李四", "SERVED_BY", title="董事")).alias("p"))
    row = df.select("p", paths.render_path("p").alias("r")).first()
    assert row["r"] == "张三 -HOLDS [5.5%]-> 000001 | 000001 -SERVED_BY [董事]-> 李四"
    assert row["p"][0]["attrs"] == {"ratio": "5.5"}


def test_alias(spark):
    assert [one(spark, names.derive_alias, x) for x in ("贵州茅台", "深圳能源", "北京A", "茅台")] == ["茅台", None, None, None]
    assert one(spark, names.matcher_norm, "万 科Ａ") == "万科"
    assert len(S.ORG_SUFFIXES) == 10
