"""The registered queries: their SQL, and the pipeline against a slow version stage by stage."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from check_oracles import compare
from readgrove.llm import decontam
from readgrove.llm.oracles import ORACLES
from readgrove.llm.queries import QUERIES

from .test_near_and_exact import near_kept
from .test_texts import checked

TABLES = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="the given tables are not here")


def test_one_query_per_operator_is_registered():
    names = contract.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()) == list(range(1, 14))
    assert "pipeline" in names and set(QUERIES) | {"pipeline"} <= set(names)
    assert set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for path in TABLES.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    assert compare(QUERIES[name](spark, str(TABLES)).toPandas(), con.execute(ORACLES[name]).df()) == "ok"


def test_pipeline_stage_by_stage(spark, tmp_path):
    documents = spark.read.parquet(str(TABLES / "documents.parquet"))
    docs, seen = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(TABLES)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == documents.columns

    scores = {r["doc_id"]: r["score"] for r in QUERIES["op4_quality_classifier"](spark, str(TABLES)).collect()}
    assert {r["doc_id"] for r in seen["quality"]} == {i for i, s in scores.items() if s >= 0.7}

    last = {r["text"]: max(x["doc_id"] for x in seen["quality"] if x["text"] == r["text"]) for r in seen["quality"]}
    assert sorted(r["doc_id"] for r in seen["exact_dedup"]) == sorted(last.values())

    near = near_kept([(r["doc_id"], r["text"]) for r in seen["exact_dedup"]])
    assert sorted(r["doc_id"] for r in seen["near_dedup"]) == sorted(near)

    passages = []
    for row in spark.read.parquet(str(TABLES / "benchmark.parquet")).collect():
        item = decontam.normalise(row["text"])
        passages += [item[a:b] for a, b in decontam.passages(len(item))]
    leaky = {r["doc_id"] for r in seen["near_dedup"] if any(p in decontam.normalise(r["text"]) for p in passages)}
    assert leaky and {r["doc_id"] for r in seen["decontamination"]} == {r["doc_id"] for r in seen["near_dedup"]} - leaky

    assert {r["doc_id"] for r in seen["packing"]} == {r["doc_id"] for r in seen["decontamination"]}
    assert checked(seen["packing"], 4096) <= sum(r["length"] for r in seen["packing"]) / 4096 + 2
    assert corpus_pipeline.run(spark, str(TABLES)).count() == len(seen["packing"])
