import hashlib

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import hashing, paths, text, vectors


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("value, want", [("parseHTTPResponse", "parse http response"), ("VectorStore", "vector store"), ("snake_case", "snake_case"), ("getX", "get x"), ("X", "x"), ("", ""), ("ABC", "abc")])
def test_split_camel_case(spark, value, want):
    assert one(spark, value, text.split_camel_case) == want


@pytest.mark.parametrize("value, want", [("fn Foo_bar(1)", ["fn", "foo", "bar", "1"]), ("", []), (None, []), ("Ä+é", ["ä", "é"])])
def test_tokenize(spark, value, want):
    assert one(spark, value, text.tokenize) == want


def test_truncation_cuts_no_character(spark):
    assert one(spark, "aé" * 10, lambda x: text.truncate_bytes(x, 5, "...")) == "aéa..."
    assert one(spark, "ab", lambda x: text.truncate_bytes(x, 5, "...")) == "ab"
    assert one(spark, "one two three", lambda x: text.truncate_words(x, 9)) == "one two"
    assert one(spark, "onetwothree", lambda x: text.truncate_words(x, 5)) == "onetw"
    assert one(spark, None, lambda x: text.truncate_words(x, 5)) is None


def test_searchable_text(spark):
    row = spark.createDataFrame([("getX", "fn getX()", ""), ("x", None, "Doc."), ("x", None, None)], "i string, s string, d string").select(text.searchable_text(F.col("i"), F.col("s"), F.col("d")).alias("y")).collect()
    assert [r.y for r in row] == ["getX getX get x\nfn getX()", "x x\nDoc.", "x x"]


def test_purpose(spark):
    assert one(spark, "  a \t b\nmore", text.clean_purpose) == "a b"
    assert one(spark, " \nmore", text.clean_purpose) is None
    assert len(one(spark, "é" * 200, text.clean_purpose)) == 140


def test_hashes(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert one(spark, "a\r\nb", hashing.content_hash) == sha("a\nb")
    assert one(spark, "p", lambda x: hashing.chunk_id(x, F.lit("c"))) == sha("chunk:p:c")
    assert one(spark, "p", lambda x: hashing.edge_id(x, F.lit("c"))) == sha("edge:p:c")


@pytest.mark.parametrize("path, want", [("a/tests/x.py", True), (".git/c", True), ("a/test_a.py", True), ("a/x_test.go", True), ("b.spec.tsx", True), ("b.spec.jsx", False), ("c.jsx", False), ("a/dist/x", True), ("src/main.rs", False), ("a/contest/x.rs", False)])
def test_skipped(spark, path, want):
    assert one(spark, path, paths.skipped) is want


def test_paths(spark):
    assert one(spark, "a\\b/c.d.rs", paths.basename) == "c.d.rs"
    assert one(spark, "a/b/", paths.basename) == "b"
    assert one(spark, "", paths.basename) == ""
    assert one(spark, "a/app.module.ts", paths.module_name) == "app.module"
    assert one(spark, "a/.hidden", paths.module_name) == ".hidden"
    assert one(spark, "x.rs", paths.project_name) == "unknown"
    assert one(spark, "p/x.rs", lambda x: paths.project_name(x, repository="r")) == "p"
    assert one(spark, "x.tsx", paths.language_of) == "typescript"


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0]), ([1.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    rows = df.select(vectors.l2_distance(F.col("a"), F.col("b")).alias("d"), vectors.cosine_similarity(F.col("a"), F.col("b")).alias("c")).collect()
    assert [(r.d, r.c) for r in rows] == [(5.0, 0.0), (0.0, 1.0)]
