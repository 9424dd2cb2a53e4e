"""The stages: columns, decisions, and the registered queries against their SQL."""

import random

import comparing
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from duewatch.llm.oracle import ORACLE
from duewatch.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"


def test_all_are_registered():
    assert {f"op{n}_" for n in range(1, 14)} == {name[: name.index("_") + 1] for name in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    ours = comparing.spark_result(QUERIES[name](spark, SMALL))
    assert comparing.difference(ours, comparing.sql_result(comparing.connect(SMALL), ORACLE[name])) == ""


@pytest.fixture
def folder(spark, make, tmp_path):
    """Documents of which the pipeline's decisions are known."""
    rng = random.Random(9)
    text = lambda n=80: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    item = text(40)
    clean = {k: text() for k in range(120)}
    toxic = {200 + k: f"{text(30)} foulroot{k % 4} {text(30)}" for k in range(60)}
    rows = [*clean.items(), *toxic.items(), (300, "too short"), (301, None), (302, clean[5]), (303, clean[6] + " tail"),
            (304, f"{text(30)} {item} {text(30)}"), (None, text())]
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k >= 200)) for k in [*clean, *toxic]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_decisions_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, gone = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        out = stage(spark, docs, folder)
        assert out.columns == columns
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        gone[name] = before - {r.doc_id for r in docs.select("doc_id").collect()}
    assert gone["quality_rules"] == {300, 301}
    assert gone["toxicity"] == {200 + k for k in range(60)}
    assert gone["jaccard_join"] == {302, 303}
    assert gone["decontamination"] == {304}
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in packed} == {*range(120), None}


def test_unlike_texts_under_one_id_stay(spark, make):
    words = [f"w{k}" for k in range(60)]
    one, near, other = " ".join(words), " ".join([*words, "tail"]), " ".join(f"z{k}" for k in range(60))
    rows = [(5, one), (5, one), (5, other), (5, " ".join(f"y{k}" for k in range(9))), (4, near), (9, other), (6, ""), (6, ""), (7, None), (None, one)]
    docs = make(rows)
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in out.collect()]
    wanted = [(4, near), (5, other), (5, rows[3][1]), (6, ""), (7, None), (None, one)]
    assert sorted(kept, key=repr) == sorted(wanted, key=repr)
