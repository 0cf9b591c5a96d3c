"""What several branches of a query need of a search is searched once."""

import re
from collections import Counter

import pytest

import __spark_entry__
from lodestrata.operators import graph

FOLDER = "/root/testdata/sf0.001"


def times_scored(df) -> int:
    """How often the plan that ran scores cells; branches that read the same shuffle count once."""
    df.collect()
    ran = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return len(re.findall("FlatMapGroupsInArrow", ran))


@pytest.mark.parametrize("name", ["graph_reserve", "graph_partition"])
def test_graph_rows_come_from_one_search(spark, name):
    assert times_scored(__spark_entry__.queries()[name](spark, FOLDER)) == 1


def test_merge_keeps_rows_without_score_and_null_keys(spark):
    results = spark.createDataFrame([("q", "a", None), ("q", "b", 0.5), ("q", None, 0.1)], "query_id string, id string, score double")
    found = spark.createDataFrame([("q", "a", 0.85), ("q", "c", 0.8), ("q", None, 0.75)], "query_id string, id string, score double")
    want = [("q", "a", None, True), ("q", "b", 0.5, False), ("q", None, 0.1, False), ("q", "c", 0.8, True), ("q", None, 0.75, True)]
    assert Counter(map(tuple, graph.merge(results, found).collect())) == Counter(want)


def test_all_pairs_name_each_document_once_for_many_questions():
    """A batch of questions has the documents' keys once, and places for its pairs."""
    import pyarrow as pa

    from lodestrata.operators.fulltext import score_cell

    rows = [(True, f"q{i}", ["a", "b"], [1.0, 0.5], None) for i in range(5)] + [(False, f"d{i}", ["a", "b"], None, None) for i in range(7)]
    kinds = [("asks", pa.bool_()), ("key", pa.string()), ("terms", pa.list_(pa.string())), ("values", pa.list_(pa.float64())), ("doc_len", pa.int64())]
    cell = pa.table([pa.array(x, kind) for x, (_, kind) in zip(zip(*rows), kinds)], names=[n for n, _ in kinds])
    for k in (None, 2):
        ((asking, sizes, ids, scores),) = score_cell(cell, 2.0, k, False)
        assert asking.to_pylist() == [f"q{i}" for i in range(5)] and sizes == [k or 7] * 5 and len(scores) == len(ids) == 5 * (k or 7)
        assert sorted(ids.dictionary.to_pylist()) == [f"d{i}" for i in range(k or 7)]
        assert [ids[i].as_py() for i in range(k or 7)] == [f"d{i}" for i in range(k or 7)]


def test_all_pairs_have_a_task_for_each_cell(spark, monkeypatch):
    from lodestrata.operators import fulltext

    monkeypatch.setattr(fulltext, "CELL_DOCS", 40)
    docs = spark.createDataFrame([(f"d{i:03d}", f"word w{i % 7}") for i in range(50)], "id string, text string")
    found = fulltext.Corpus.of(docs).scores(docs.limit(3).selectExpr("id as query_id", "text as query"))
    assert found.count() == 150 and "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()


def test_vectors_are_sent_once_for_many_questions(spark):
    """8,000 questions make one block, and floats stay floats on their way; distances are as from doubles."""
    from lodestrata.operators import vectors

    assert vectors.blocks(800_000, 8_000) == (49, 1)
    rows = spark.createDataFrame([(i, [0.1 * i, 1.0 / (i + 3)]) for i in range(30)], "id long, vector array<float>")
    asked = rows.where("id % 10 = 0").withColumnRenamed("id", "query_id")
    found = vectors.knn_batch(rows, asked, 3, 2, 8)
    assert "array<double>" not in found._jdf.queryExecution().executedPlan().toString()
    double = lambda d: d.withColumn("vector", d.vector.cast("array<double>"))
    assert Counter(map(tuple, found.collect())) == Counter(map(tuple, vectors.knn_batch(double(rows), double(asked), 3, 2, 8).collect()))


def test_links_of_a_hot_chunk_are_not_repeated_for_each_question(spark, tmp_path):
    """graph_partition on 60 questions about one chunk that 500 edges lead to: as SQL says, and its shuffles don't carry 60 x 500 rows."""
    import duckdb

    ids = [f"{i:052x}{100 * i:012x}" for i in range(60)]
    chunks = [(x, "getValue", "getValue getValue get value", 1) for x in ids]
    links = [(f"e{i}", f"{9000 + i:064x}", ids[0], 1 + i % 3) for i in range(500)] + [(f"f{i}", ids[-i - 1], ids[0], 3) for i in range(55)]
    named = [f"'' as {x}" for x in ("caller_identifier", "callee_identifier", "caller_file", "callee_file", "project_name")]
    spark.createDataFrame(chunks, "chunk_id string, identifier string, searchable_text string, ingested_at long").write.parquet(f"{tmp_path}/code_chunks.parquet")
    spark.createDataFrame(links, "edge_id string, caller_chunk_id string, callee_chunk_id string, resolution_tier int").selectExpr("*", *named).write.parquet(f"{tmp_path}/call_edges.parquet")
    sc = spark.sparkContext

    def stages() -> dict:
        found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in map(found.apply, range(found.size()))}

    before = stages()
    got = __spark_entry__.queries()["graph_partition"](spark, str(tmp_path)).collect()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    con = duckdb.connect()
    for t in ("code_chunks", "call_edges"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    assert Counter(map(tuple, got)) == Counter(con.execute(__spark_entry__.oracle_sql()["graph_partition"]).fetchall()) and len(got) == 60 * 5
    assert max(n for x, n in stages().items() if x not in before) < 10_000


def test_best_links_are_enough_to_prepend(spark):
    """Four rows of the graph are prepended, ten results may be among them: the best fourteen and those that are results give the same as all."""
    import random

    r = random.Random(7)
    nodes = [f"n{i:02d}" for i in range(40)]
    edges = spark.createDataFrame([(r.choice(nodes), r.choice(nodes[:3] if i % 2 else nodes), r.choice([1, 2, 3, None])) for i in range(600)], "caller string, callee string, tier int")
    targets = spark.createDataFrame([(f"q{i}", nodes[i % 5], ("callers", "callees", "both")[i % 3]) for i in range(30)], "query_id string, node string, direction string")
    results = spark.createDataFrame([(f"q{i}", x, r.random()) for i in range(3, 32) for x in r.sample(nodes, 10)], "query_id string, id string, score double")
    last = lambda merged: Counter(map(tuple, graph.prepend(merged.selectExpr("*", "row_number() over (partition by query_id order by from_graph, round(score, 9) desc, id) as pos"), 5).collect()))
    every, best = graph.merge(results, graph.augment(targets, edges)), graph.merge_best(results, targets, edges, 14)
    assert last(every) == last(best) and best.count() < every.count()
