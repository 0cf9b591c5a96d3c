from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestrata.plans import harness, seams
from lodestrata.plans.retrieve import EngineConfig, retrieve
from lodestrata.sources import workspace
from lodestrata.sources.tables import Tables

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")


def test_a_failing_reranker_leaves_the_search_at_its_final_limits(spark):
    def fails(queries, texts):
        raise RuntimeError("no model")

    t = Tables(spark, FOLDER)
    asked = spark.createDataFrame([("a", "What is the purpose of this project?", "overview")], "query_id string, query string, intent string")
    kinds = lambda found: {(r.chunk_type, r.id, r.pos) for r in found.lists.collect()}
    plain = retrieve(t, asked)
    assert {k for k, _, _ in kinds(plain)} == {"code", "readme", "crate", "module_doc", "folder", "file"}
    fallen = kinds(retrieve(t, asked, EngineConfig(rerank=True, fallback=True), score=seams.guarded(fails)))
    four = ("code", "readme", "crate", "module_doc")
    assert {x for x in fallen if x[0] in four} == {x for x in kinds(plain) if x[0] in four}
    ranked = kinds(retrieve(t, asked, EngineConfig(rerank=True, fallback=True)))
    assert {k: sum(x[0] == k for x in ranked) for k in four} == {"code": 5, "readme": 3, "crate": 3, "module_doc": 3}


def test_no_questions_and_questions_without_terms(spark):
    t = Tables(spark, FOLDER)
    schema = "query_id string, query string"
    assert retrieve(t, spark.createDataFrame([], schema)).flat().count() == 0
    assert {r.query_id for r in retrieve(t, spark.createDataFrame([("x", "???")], schema)).flat().collect()} == {"x"}


def test_harness_reports(spark):
    t = Tables(spark, FOLDER)
    one = t.code("identifier", "file_path").first()
    text = f'{{"cases": [{{"id": "c", "query": "How does {one.identifier} work?", "expected_intent": "implementation", "expected_files": ["{one.file_path}"], "tags": ["x"]}}, {{"id": "d", "query": "q", "expected_files": ["no/such"], "tags": ["y"]}}]}}'
    cases = workspace.parsed_cases(spark.createDataFrame([(text,), ("no json",)], "json string"))
    run = harness.run(t, cases, ground_truth=True, tags=["x", "z"])
    s = run.summary()
    assert s["overall"]["cases"] == 1 and s["overall"]["intent_accuracy"] == 1.0
    assert run.as_markdown().startswith("| intent | cases |") and '"never_found"' in run.as_json()
    assert harness.expectations(cases).where("case_id = 'd'").select("kind", "expected").collect() == [("file", "no/such")]


def test_stand_in_vectors(spark):
    df = spark.createDataFrame([("a b b",), ("",), (None,)], "x string").select(seams.term_vector(F.col("x"), 4).alias("v"))
    long, empty, null = (r.v for r in df.collect())
    assert abs(sum(x * x for x in long) - 1) < 1e-9 and empty == null == [0.0] * 4
