import duckdb
import pytest

import __spark_entry__ as entry_module

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["T_holding", "R1", "R3", "RE", "G4", "Q6", "EV3", "MRG2", "D6", "LNK6", "TXT4", "A14", "STR1_batch"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def text(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    df = entry_module.queries()[name](spark, FOLDER)
    got = df.collect()
    rel = con.execute(entry_module.oracle_sql()[name])
    columns = [d[0] for d in rel.description]
    assert sorted(columns) == sorted(df.columns)
    assert text(got, df.columns) == text(rel.fetchall(), columns)


def test_invariants(spark):
    pairs = {(r[0], r[1][2:]) for r in entry_module.queries()["R3"](spark, FOLDER).select("subject_code", "party_id").collect()}
    assert pairs == {(b, a) for a, b in pairs}
    assert entry_module.entry(spark).where("score_c > 100 OR score_c <= 0").count() == 0


def test_facts_are_read_back_pruned(spark):
    from kinweave.sources.tables import Tables
    plan = Tables(spark, FOLDER).holding.where("ratio >= 5").select("entity_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ratio), GreaterThanOrEqual(ratio,5.0)]" in plan and "ReadSchema: struct<entity_id:bigint,ratio:double>" in plan


def test_found_are_the_parties_without_paths(spark):
    from kinweave.sources.tables import Tables
    t = Tables(spark, FOLDER)
    columns = [c for c in t.parties.columns if c != "path"]
    assert t.found.columns == columns
    assert t.found.exceptAll(t.parties.select(columns)).count() == 0 and t.found.count() == t.parties.count()


def test_f5_asks_for_no_paths(spark, monkeypatch):
    """Its rows are codes and rules alone, so neither the runs nor the parties with paths are written for it."""
    from kinweave.catalog import all_queries
    from kinweave.sources.tables import Tables
    none = spark.createDataFrame([("000001", "C:000002", "R2", "high"), ("000001", "C:000003", "R3", "low")],
                                 "subject_code string, party_id string, rule_id string, confidence string")
    monkeypatch.setattr(Tables, "found", property(lambda self: none))
    monkeypatch.setattr(Tables, "parties", property(lambda self: 1 / 0))
    assert [tuple(r) for r in all_queries()["F5"](spark, "/root/testdata/sf0.001").collect()] == [("000001", "C:000002")]


def test_holdings_join_the_big_tables_once(spark):
    """Ranks and totals of the holdings share one shuffle of the amounts."""
    from kinweave.sources.tables import Tables
    df = Tables(spark, FOLDER)._holding()
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan parquet [l_orderkey") == 1
