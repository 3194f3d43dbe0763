"""The pipeline against plain versions of its stages, and what the entry module offers."""
from collections import Counter

import __spark_entry__ as entry_module
import corpus_pipeline
from kinweave.llm import mixing, toxicity
from tests.llm.common import documents, empty
from tests.llm.test_maps import jump
from tests.llm.test_texts import near_copies, plain_components, plain_hits, toxic_corpus


def stand_in(spark, monkeypatch, labels, bench):
    tables = {"labels": spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), "benchmark": spark.createDataFrame(bench, "item_id long, text string")}
    monkeypatch.setattr(corpus_pipeline, "table", lambda s, folder, name: tables[name])
    return tables


def test_stages(spark, monkeypatch, tmp_path):
    toxic, labels = toxic_corpus(240)
    bench = [(1, "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 q11"), (2, "")]
    rows = [*toxic, *[(1000 + i, t, "en", f"s{i % 3}", 0) for i, t in near_copies(80)], (2000, toxic[1][1] + " " + bench[0][1] + " " + toxic[2][1], "en", "s1", 0), (2001, None, "en", None, 0), (2002, "", "en", "s1", 0)]
    tables = stand_in(spark, monkeypatch, labels, bench)
    docs = documents(spark, rows)
    names, held = docs.columns, {r[0]: r for r in rows}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id for r in docs.collect()}
        stage(spark, docs, "unused").write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        ids = Counter(r.doc_id for r in after.collect())
        if k < 4:
            assert after.columns == names
        if name == "toxicity":
            scores = {r.doc_id: r.predicted for r in toxicity.score_documents(docs, tables["labels"]).collect()}
            assert ids == Counter(i for i in before if not scores[i]) and sum(scores.values()) > 20
        elif name == "near_duplicates":
            want = plain_components([(i, held[i][1]) for i in before], 5, 80)
            assert ids == Counter(i for i in before if want[i][1] == i) and len(ids) < len(before)
        elif name == "decontamination":
            assert ids == Counter(i for i in before if not plain_hits(held[i][1], bench)[1]) and 2000 in before and 2000 not in ids
        elif name == "mixing":
            assert ids == Counter({r.key: r.times for r in mixing.plan(docs).collect() if r.times})
        else:
            assert {(r.doc_id, r.shard) for r in after.collect()} == {(i, jump(i, 24)) for i in before}
        docs = after


def test_empty(spark, monkeypatch, tmp_path):
    stand_in(spark, monkeypatch, [], [])
    docs = empty(spark)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "unused").write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.count() == 0


def test_registered():
    names = entry_module.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert "op7_water_filling" in entry_module.oracle_sql()
