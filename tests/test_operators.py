import re

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import edges, evaluation, fulltext, fusion, graph, intent, reconcile, vectors

EDGES = [("a", "b"), ("b", "c"), ("a", "d"), ("c", "a"), ("a", "b")]


def e(spark):
    return spark.createDataFrame(EDGES, "caller string, callee string")


def starts(spark, *nodes):
    return spark.createDataFrame([(n,) for n in nodes], "node string")


def test_bfs_ends_on_cycles(spark):
    assert {(r.node, r.depth) for r in graph.bfs(e(spark), starts(spark, "a"), "callees", 9).collect()} == {("b", 1), ("d", 1), ("c", 2)}
    assert {(r.node, r.depth) for r in graph.bfs(e(spark), starts(spark, "a"), "callers", 1).collect()} == {("c", 1)}
    assert graph.bfs(e(spark), starts(spark, "zz"), "callees", 3).count() == 0


def test_shortest_path(spark):
    assert graph.shortest_path(e(spark), "a", "c").first().path == ["a", "b", "c"]
    assert graph.shortest_path(e(spark), "a", "a").first().path == ["a"]
    assert graph.shortest_path(e(spark), "d", "a").count() == 0


@pytest.mark.parametrize("q, target, way", [
    ("What calls parse_it?", "parse_it", "callers"), ("what does the function parse call", "parse", "callees"), ("Who calls the method `go`?", "go", "callers"), ("callees of run", "run", "both"),
    ("Show `x_y` now", "x_y", "both"), ("Tell me more", None, "both"), ("Where is load called", None, "callers"),
])
def test_questions(spark, q, target, way):
    r = spark.createDataFrame([(q,)], "q string").select(graph.extract_target(F.col("q")).alias("t"), graph.detect_direction(F.col("q")).alias("d")).first()
    assert (r.t, r.d) == (target, way)


@pytest.mark.parametrize("q, want", [
    ("How does the A differ from a B?", ["a", "b"][:0] or None), ("Compare Foo and the Bar", ["foo", "bar"]), ("foo vs. bar?", ["foo", "bar"]), ("difference between an index and a cache", ["index", "cache"]),
    ("How do foo and bar compare?", ["foo", "bar"]), ("foo vs foo", None), ("nothing here", None),
])
def test_comparators(spark, q, want):
    assert spark.createDataFrame([(q,)], "q string").select(intent.comparators(F.col("q")).alias("c")).first().c == want


@pytest.mark.parametrize("q, want", [("Compare A and B", "comparison"), ("the difference it makes to compare x", None), ("open a_vs_b.py vs c", None), ("A vs B", "comparison"), ("different ideas", None), ("X differs here", "comparison")])
def test_pre_classify(spark, q, want):
    assert spark.createDataFrame([(q,)], "q string").select(intent.pre_classify(F.col("q")).alias("c")).first().c == want


def rows(spark, *r):
    return spark.createDataFrame([("q", *x) for x in r], "query_id string, id string, score double, from_graph boolean, pos int")


def kept(df):
    return [r.id for r in sorted(df.collect(), key=lambda r: r["rank"])]


def test_reserve_lifts_graph_rows_over_the_weakest(spark):
    table = rows(spark, ("a", 0.9, False, 1), ("b", 0.1, False, 2), ("c", 0.5, False, 3), ("g", 0.8, True, 4), ("h", 0.7, True, 5))
    assert kept(graph.reserve(table, 3, 1)) == ["a", "g", "c"]
    assert kept(graph.reserve(table, 3, 0)) == ["a", "b", "c"]
    assert kept(graph.reserve(table, 3, 2)) == ["a", "g", "h"]
    assert kept(graph.prepend(table, 3)) == ["g", "h", "a"]


def test_edge_tiers(spark):
    chunks = spark.createDataFrame([("1", "main", "a.rs"), ("2", "f", "a.rs"), ("3", "f", "b.rs"), ("4", "g", "b.rs"), ("5", "g", "x/util.rs"), ("6", "h", "c.rs"), ("7", "k", "b.rs"), ("8", "k", "c.rs")], "chunk_id string, identifier string, file_path string")
    calls = spark.createDataFrame([("1", n) for n in ("f", "g", "h", "k", "main", "none")], "caller string, callee_identifier string")
    imports = spark.createDataFrame([("a.rs", "g", "zz::nowhere", 0), ("a.rs", "g", "super::super::util", 1), ("a.rs", "k", "nowhere", 2)], "file_path string, imported_name string, source_path string, position long")
    assert {(r.callee_identifier, r.callee, r.tier) for r in edges.resolve(chunks, calls, imports).collect()} == {("f", "2", 1), ("g", "5", 2), ("h", "6", 3)}


def test_bm25_and_idf(spark):
    docs = spark.createDataFrame([("1", "fn retrieve fn"), ("2", "fn search"), ("3", None)], "id string, text string")
    corpus = fulltext.Corpus.of(docs)
    assert corpus.n_docs == 3 and corpus.average == 5 / 3
    q = spark.createDataFrame([("q", "retrieve"), ("z", "nothing"), ("e", "")], "query_id string, query string")
    assert [(r.query_id, r.id) for r in corpus.topk(q, 5).collect()] == [("q", "1")]
    assert {(r.term, r.df) for r in fulltext.idf_table(docs).collect()} == {("fn", 2), ("retrieve", 1), ("search", 1)}


def many(spark):
    docs = spark.range(700).select(F.col("id").cast("string"), F.concat_ws(" ", F.lit("all"), F.concat(F.lit("w"), F.col("id") % 7), F.repeat(F.lit("pad "), (F.col("id") % 3).cast("int"))).alias("text"))
    return docs, docs.where("id < 100").select(F.col("id").alias("query_id"), F.col("text").alias("query"))


def unjoined(spark, make):
    """The rows of a plan and its text, where no join is broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = make()
        return df.collect(), df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_bm25_shuffles_no_pairs(spark):
    docs, queries = many(spark)
    corpus = fulltext.Corpus.of(docs)
    for make in (lambda: corpus.topk(queries, 5), lambda: corpus.scores(queries)):
        got, plan = unjoined(spark, make)
        assert "hashpartitioning(query_id" in plan and not re.search(r"hashpartitioning\(query_id#\d+, id#", plan)
    assert len(got) == 700 * queries.count()


def test_bm25_in_cells(spark, monkeypatch):
    docs, queries = many(spark)
    corpus = fulltext.Corpus.of(docs)
    pairs = lambda rows: {(r.query_id, r.id): round(r.score, 9) for r in rows}
    want, best = pairs(corpus.scores(queries).collect()), pairs(corpus.topk(queries, 5).collect())
    monkeypatch.setattr(fulltext, "CELL_DOCS", 60)
    monkeypatch.setattr(fulltext, "CELL_QUERIES", 9)
    assert pairs(corpus.scores(queries).collect()) == want and pairs(corpus.topk(queries, 5).collect()) == best
    for q in {q for q, _ in best}:
        assert sorted(((-s, i) for (p, i), s in want.items() if p == q))[:5] == sorted((-s, i) for (p, i), s in best.items() if p == q)


def test_best_of_a_cell_same_as_all(monkeypatch):
    """Terms as a matrix or one by one, groups or none, k or all: the same scores and ranks."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(60)]
    texts = [[words[min(59, int(x))] for x in rng.exponential(8, 1 + i % 9)] for i in range(500)]
    made = [(False, f"{i % 450:03d}", x, None, None) for i, x in enumerate(texts)]
    made += [(True, f"q{i}", sorted(set(x)), [1 + 0.1 * int(w[1:]) for w in sorted(set(x))], None) for i, x in enumerate(texts[:150])]
    cell = pa.table({n: pa.array(x, t) for n, x, t in zip(("asks", "key", "terms", "values", "doc_len"), zip(*made), (pa.bool_(), pa.string(), pa.list_(pa.string()), pa.list_(pa.float64()), pa.int64()))})

    def lists(k):
        out = {}
        for keys, sizes, ids, scores in fulltext.score_cell(cell, 5.0, k, False):
            ends = np.cumsum(sizes)
            for q, to, n in zip(keys.to_pylist(), ends, sizes):
                out[q] = sorted(zip(-np.round(scores[to - n : to], 9), ids.to_pylist()[to - n : to]))
        return out

    monkeypatch.setattr(fulltext, "MATRIX", 0)
    want = lists(None)
    for matrix, group in ((0, 64), (30, 64), (30, 7), (10**9, 7)):
        monkeypatch.setattr(fulltext, "MATRIX", matrix)
        monkeypatch.setattr(fulltext, "GROUP", group)
        for got, most in ((lists(None), None), (lists(10), 10)):
            assert {q: [i for _, i in x] for q, x in got.items()} == {q: [i for _, i in x[:most]] for q, x in want.items()}


def test_blocks():
    """20,000 questions repeat no document; long documents and all pairs make smaller blocks."""
    assert fulltext.blocks(1_000_000, 20_000, 15.0, 10) == (31, 1)
    assert fulltext.blocks(1_000_000, 20_000, 500.0, 10) == (250, 1)
    assert fulltext.blocks(1_000_000, 20_000, 15.0, None) == (123, 1)
    assert fulltext.blocks(0, 0, 0.0, 10) == (1, 1)


def test_index_search_shuffles_no_pairs(spark, tmp_path):
    docs, queries = many(spark)
    fulltext.write_index(docs, str(tmp_path / "index"))
    index = fulltext.Index.open(spark, str(tmp_path / "index"))
    got, plan = unjoined(spark, lambda: index.topk(queries, 5))
    assert not re.search(r"hashpartitioning\(query_id#\d+, id#", plan)
    rows = lambda d: {(r.query_id, r.id, round(r.score, 9), r["rank"]) for r in d}
    assert rows(got) == rows(fulltext.Corpus.of(docs).topk(queries, 5).collect())
    index.postings.join(index.frequencies, "term").write.parquet(str(tmp_path / "older" / "postings"), partitionBy="bucket")
    spark.read.parquet(str(tmp_path / "index" / "totals")).write.parquet(str(tmp_path / "older" / "totals"))
    assert rows(fulltext.Index.open(spark, str(tmp_path / "older")).topk(queries, 5).collect()) == rows(got)


def test_rrf_ties_by_id(spark):
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "query_id string, id string, rank int")
    b = spark.createDataFrame([("q", "y", 1), ("q", "x", 2)], "query_id string, id string, rank int")
    got = sorted(fusion.rrf([a, b]).collect(), key=lambda r: r["rank"])
    assert [r.id for r in got] == ["x", "y"] and abs(got[0].score - (1 / 61 + 1 / 62)) < 1e-12


def test_knn_batch_in_blocks(spark):
    v = spark.createDataFrame([(i, [float(i % 17), float(i % 5)]) for i in range(100)] + [(500, None), (501, [1.0])], "id long, vector array<double>")
    q = v.where("id < 10").withColumnRenamed("id", "query_id")
    one = {(r.query_id, r.id, r["rank"]) for r in vectors.knn_batch(v, q, 5, 2).collect()}
    assert one == {(r.query_id, r.id, r["rank"]) for r in vectors.knn_batch(v, q, 5, 2, block=7).collect()}
    assert len(one) == 50


def test_reconcile(spark):
    schema = "chunk_id string, file_path string, content_hash string, n int"
    old = spark.createDataFrame([("1", "a", "h1", 1), ("2", "b", "h2", 1), ("3", "c", "h3", 1)], schema)
    new = spark.createDataFrame([("1", "a", "h1", 2), ("4", "b", "h9", 2), ("5", "d", "h5", 2)], schema)
    keyed = lambda d: d.select(F.col("file_path").alias("path"), "content_hash")
    state = reconcile.status(keyed(old), keyed(new))
    assert {(r.path, r.status) for r in state.collect()} == {("a", "unchanged"), ("b", "changed"), ("c", "deleted"), ("d", "new")}
    assert reconcile.stats(state).first().asDict() == {"unchanged": 1, "changed": 1, "new": 1, "deleted": 1}
    assert {(r.chunk_id, r.n) for r in reconcile.incremental(old, new).collect()} == {("1", 1), ("4", 2), ("5", 2)}
    assert {(r.chunk_id, r.n) for r in reconcile.upsert(old, new.unionByName(new), "chunk_id").collect()} == {("1", 2), ("2", 1), ("3", 1), ("4", 2), ("5", 2)}
    assert {r.chunk_id for r in reconcile.deletions(old, new).collect()} == {"2", "3"}
    assert reconcile.incremental(old.limit(0), new).count() == 3
    assert reconcile.delete_where(old.withColumn("n", F.lit(None).cast("int")), F.col("n") > 0).count() == 3


def test_evaluation(spark):
    cases = spark.createDataFrame([("c", "file", "lib.rs"), ("c", "file", "no.rs"), ("c", "identifier", "f"), ("d", "file", "zz")], "case_id string, kind string, expected string")
    got = spark.createDataFrame([("c", 1, "code", "src/x.rs", "g", "p", 0.9), ("c", 2, "code", "src/lib.rs", "f", "p", 0.4)], "case_id string, rank int, chunk_type string, file_path string, identifier string, project string, relevance double")
    assert {(r.case_id, round(r.recall, 4)) for r in evaluation.recall(cases, got, 5).collect()} == {("c", 0.6667), ("d", 0.0)}
    assert {(r.case_id, round(r.recall, 4)) for r in evaluation.recall(cases, got, 1).collect()} == {("c", 0.0), ("d", 0.0)}
    assert {(r.case_id, r.mrr) for r in evaluation.reciprocal_rank(cases, got).collect()} == {("c", 0.5), ("d", 0.0)}
    assert {r.expected for r in evaluation.never_found(cases, got).collect()} == {"no.rs", "zz"}
