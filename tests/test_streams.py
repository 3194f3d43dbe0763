from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from kinweave.streaming import focus as fc, windows as sw
from tests.conftest import rows

TURN = "session string, turn int, ord int, kind string, code string, name string, ts timestamp"


def test_a_turn_split_over_batches_is_given_once(spark, tmp_path):
    """Turn 1 of session s comes in two batches, turn 9 closes it; a row that comes after that is late. Session u has no turn that closes."""
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    at = lambda m: start + timedelta(minutes=m)
    batches = [
        [("s", 1, 0, "user_mention", "a", "A", at(0)), ("s", 0, 0, "result_item", "z", "Z", at(-1))],
        [("s", 1, 1, "user_mention", "b", "B", at(2)), ("s", 1, 0, "result_item", "r", "R", at(1)), ("u", 5, 0, "user_mention", "q", "Q", at(39))],
        [("s", 9, 0, "result_item", "k", "K", at(40))],
        [("s", 1, 7, "user_mention", "late", "L", at(3))],
    ]
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    for batch in batches:
        spark.createDataFrame(batch, TURN).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(TURN).parquet(source)
        with fc.with_timers(spark):
            fc.closed_focus(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
                "checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    got = rows(spark.read.parquet(str(tmp_path / "out")), "session", "turn", "focus_code", "n_focus", "n_results")
    assert got == [("s", 0, "z", 1, 1), ("s", 1, "b", 4, 1)]


def test_answers_between_people_and_companies(spark):
    """One ask per kind of side: rules first, then the walk; what two questions share is answered once; sides that are unclear are not."""
    from kinweave.operators import network
    from kinweave.plans import answers as an
    slot = "id int, intent string, company string, entity_a string, entity_b string, entity string, relation_type string, role_type string, event_types string, company_a string, company_b string, clarify int"
    none = lambda i, intent, **kw: tuple({"id": i, "intent": intent, "clarify": 0, **kw}.get(c.split()[0]) for c in slot.split(", "))
    slots = spark.createDataFrame([
        none(1, "Q2", entity_a="000001", entity_b="甲"), none(2, "Q2", entity_a="000001", entity_b="甲"), none(3, "Q2", entity_a="乙", entity_b="000003"), none(4, "Q4", company="000001", role_type="director"),
        none(5, "Q3", entity="甲", relation_type="serve"), none(6, "Q7"), none(7, "Q8", company_a="000001", company_b=""), none(8, "Q6", company_a="000001", company_b="000001"), none(9, "Q3", entity="丙")], slot)
    linked = spark.createDataFrame([
        (1, "entity_a", "000001", "given", "linked"), (1, "entity_b", "11", "name", "linked"), (2, "entity_a", "000001", "given", "linked"), (2, "entity_b", "11", "name", "linked"),
        (3, "entity_a", "12", "name", "linked"), (3, "entity_b", "000003", "given", "linked"), (4, "company", "000001", "given", "linked"), (5, "entity", "11", "given", "linked"),
        (8, "company_a", "000001", "given", "linked"), (8, "company_b", "000001", "given", "linked"), (9, "entity", None, "not_found", "clarify")], "id int, slot string, value string, method string, state string")
    asked = an.asks(slots, linked)
    assert rows(asked, "id", "a", "b", "option", "state") == sorted([
        (1, "C:000001", "E:11", None, "ready"), (2, "C:000001", "E:11", None, "ready"), (3, "E:12", "C:000003", None, "ready"), (4, "C:000001", None, "director", "ready"),
        (5, "E:11", None, "serve", "ready"), (6, None, None, None, "open"), (7, "C:000001", None, None, "open"), (8, "C:000001", "C:000001", None, "clarify"), (9, None, None, None, "clarify")], key=str)
    company = spark.createDataFrame([(f"00000{i}", f"公司{i}", "x", 0) for i in (1, 2, 3)], "stock_code string, short_name string, industry string, is_st int")
    entity = spark.createDataFrame([(11, "person", "甲", "甲", 0), (12, "person", "乙", "乙", 0)], "entity_id bigint, entity_type string, canonical_name string, display_name string, is_channel int")
    holding = spark.createDataFrame([(1, 12, "000002", "p", 3.0, 1, "s", "2024")], "id bigint, entity_id bigint, stock_code string, report_period string, ratio double, holder_rank int, source string, valid_from string")
    position = spark.createDataFrame([(1, 11, "000001", "董事", "2024", "s"), (2, 11, "000002", "监事", "2024", "s"), (3, 11, "000003", "董事", "2024", "s")], "id bigint, entity_id bigint, stock_code string, title string, valid_from string, source string")
    controller = spark.createDataFrame([], "id bigint, entity_id bigint, stock_code string, control_ratio double, valid_from string, source string")
    event = spark.createDataFrame([], "event_id bigint, subject_code string, event_type string, event_date string, amount double")
    parties = spark.createDataFrame([("000001", "E:11", "甲", "R9", "high", None, 1.0)], "subject_code string, party_id string, party_name string, rule_id string, confidence string, path string, score double")
    parties = parties.withColumn("path", F.expr("cast(array() AS array<struct<frm:string,edge:string,to:string,attrs:struct<ratio:string,title:string>>>)"))
    links = network.links(network.edges(entity, holding, position, controller))
    got = an.answers(asked, company, entity, holding, controller, position, event, parties, links)
    assert rows(got.where("intent = 'Q2'"), "a", "b", "item", "detail", "text") == [
        ("C:000001", "E:11", "related", "R9|high", ""), ("E:12", "C:000003", "related", "", "E:12 -> C:000002 -> E:11 -> C:000003")]
    assert rows(got.where("intent = 'Q4'"), "item", "detail", "text") == [("甲", "director", "董事")]
    assert rows(got.where("intent = 'Q3'"), "item", "detail", "text") == [("公司1", "serve", "董事"), ("公司2", "serve", "监事"), ("公司3", "serve", "董事")]
    assert got.where("intent IN ('Q1', 'Q5', 'Q6', 'Q7', 'Q8')").count() == 0
