from pathlib import Path

import pytest

from lodestrata.api import RetrievalEngine
from lodestrata.sources import parsers, tables, workspace
from lodestrata.sources.bundle import read_bundle, write_bundle
from lodestrata.sources.tables import check_schema_version, newest
from lodestrata.sources.store import ChunkStore, check_model, ingest_full, ingest_incremental
from lodestrata.streaming.reconcile import upsert_stream

FIXTURES = Path(__file__).resolve().parent / "fixtures"


def test_workspace(spark):
    files = workspace.walk(spark, str(FIXTURES / "workspace"))
    assert {r.file_path for r in files.collect()} == {"project1/README.md", "project1/main.py", "project1/multi.py", "project2/Cargo.toml", "project2/src/lib.rs", "web/app.ts", "web/main.go"}
    chunks = {(r.file_path, r.identifier, r.node_type): r for r in workspace.code_chunks(files).collect()}
    assert {k[1] for k in chunks} == {"hello", "func_a", "func_b", "func_c", "Box", "open", "Store", "close", "start", "twice", "View", "render", "Run", "Job"}
    rust = chunks["project2/src/lib.rs", "open", "function_item"]
    assert (rust.docstring, rust.signature, rust.calls, rust.start_line) == ("Opens the store.", "pub fn open(path: &str) -> Store", ["read_all"], 7)
    assert len({r.content_hash for r in chunks.values() if r.file_path == "project1/multi.py"}) == 1
    assert workspace.manifests(files).first().dependencies == ["util"]
    assert workspace.module_docs(files).first().doc_content == "Keeps the index of the store.\nTwo lines."
    assert {(r.imported_name, r.source_path) for r in workspace.imports(files).where("file_path like '%.rs'").collect()} == {("read_all", "crate::util"), ("write_all", "crate::util")}


def test_parsers_on_broken_text():
    assert parsers.chunks_of("def (:", "python") == []
    assert parsers.chunks_of("fn a( {", "rust")[0].identifier == "a"
    assert parsers.chunks_of("x", "cobol") == [] and parsers.chunks_of("", "go") == []
    assert parsers.manifest("[workspace]\nmembers = []") is None and parsers.manifest("=") is None
    assert parsers.imports_of("from a import b, c as d", "python") == [("b", "a")]


def test_schema_version(spark, tmp_path):
    assert check_schema_version(spark, str(tmp_path / "db")) == 1 == check_schema_version(spark, str(tmp_path / "db"))
    (tmp_path / "db" / "_schema_version").unlink()
    (tmp_path / "db" / "._schema_version.crc").unlink(missing_ok=True)
    (tmp_path / "db" / "_schema_version").write_text("7")
    with pytest.raises(ValueError):
        check_schema_version(spark, str(tmp_path / "db"))


def test_newest(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), (None, 3, "z"), ("b", None, "w")], "k string, t int, v string")
    assert {(r.k, r.v) for r in newest(df, "k", "t").collect()} == {("a", "y"), ("b", "w")}


def rows_of(store, name="code_chunks"):
    return {(r.chunk_id, r.n) for r in store.read(name).collect()}


def test_stream_upserts_touched_buckets_only(spark, tmp_path):
    schema, store = "chunk_id string, n int", ChunkStore(spark, str(tmp_path / "out"), buckets=16)
    stored = [(f"k{i}", 0) for i in range(40)]
    for i, rows in enumerate((stored, [("k1", 1), ("new", 1), (None, 1)], [("k1", 2)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        before = {p.parent.name: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.parquet")}
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        upsert_stream(stream, store, "code_chunks", str(tmp_path / "cp"), "n").awaitTermination()
        after = {p.parent.name: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.parquet")}
        assert not i or sum(after[k] != v for k, v in before.items()) <= 2
    assert rows_of(store) == {("k1", 2), ("new", 1), *((k, 0) for k, _ in stored if k != "k1")}


def test_store_upserts_deletes_and_reads_what_is_missing(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "db"), buckets=4)
    df = lambda rows: spark.createDataFrame(rows, "chunk_id string, n int")
    assert store.read("code_chunks", df([("a", 1)])).count() == 0
    store.delete("code_chunks", df([]).chunk_id == "a")
    store.upsert("code_chunks", df([]))
    store.upsert("code_chunks", df([("a", 1), ("b", 1), ("b", 1), (None, 9)]))
    store.upsert("code_chunks", df([("b", 2), ("b", 3)]), newest="n")
    assert rows_of(store) == {("a", 1), ("b", 3)}
    store.delete_ids("code_chunks", spark.createDataFrame([("a",), (None,), ("zz",)], "x string"))
    assert rows_of(store) == {("b", 3)}
    from pyspark.sql import functions as F

    store.delete("code_chunks", F.col("n") > 2)
    assert rows_of(store) == set()


def test_ingestion_writes_and_guards(spark, tmp_path):
    schema = "chunk_id string, file_path string, content_hash string, project_name string, searchable_text string, embedding_model_version string"
    df = lambda rows: spark.createDataFrame([(i, p, h, "x", f"text of {i}", "m1") for i, p, h in rows], schema)
    store = ChunkStore(spark, str(tmp_path / "db"), buckets=4)
    first = [("1", "a.rs", "h"), ("2", "a.rs", "h"), ("3", "b.rs", "h"), ("4", "c.rs", "h")]
    ingest_full(store, {"code_chunks": df(first)})
    again = ingest_incremental(store, {"code_chunks": df(first)}, model="m1")["code_chunks"]
    assert {r.status for r in again.collect()} == {"unchanged"}
    new = [("1", "a.rs", "h2"), ("5", "a.rs", "h2"), ("3", "b.rs", "h"), ("6", "d.rs", "h")]
    dry = ingest_incremental(store, {"code_chunks": df(new)}, dry_run=True)["code_chunks"]
    want = {("a.rs", "changed"), ("b.rs", "unchanged"), ("c.rs", "deleted"), ("d.rs", "new")}
    assert {tuple(r) for r in dry.collect()} == want and {r.chunk_id for r in store.read("code_chunks").collect()} == set("1234")
    assert {tuple(r) for r in ingest_incremental(store, {"code_chunks": df(new)})["code_chunks"].collect()} == want
    assert {(r.chunk_id, r.content_hash) for r in store.read("code_chunks").collect()} == {("1", "h2"), ("5", "h2"), ("3", "h"), ("6", "h")}
    with pytest.raises(ValueError):
        check_model(store, "code_chunks", "m2")
    ingest_full(store, {"code_chunks": df([("9", "z.rs", "h")])})
    assert {r.chunk_id for r in store.read("code_chunks").collect()} == {"9"}


def test_engine(spark, tmp_path):
    engine = RetrievalEngine(spark, "/root/testdata/sf0.001")
    asked = engine.tables.code("identifier").limit(2).selectExpr("chunk_id as query_id", "identifier as query")
    assert engine.search(asked).count() > 0
    assert engine.list_projects().count() == engine.overview().count()
    chunk = engine.tables.code("file_path").first()
    assert engine.neighbors(chunk.chunk_id).where(f"chunk_id = '{chunk.chunk_id}'").count() == 1
    assert engine.reindex(str(FIXTURES / "workspace")).count() == 15
    engine.export(str(tmp_path / "bundle"))
    assert read_bundle(spark, str(tmp_path / "bundle")).where("section = 'crate'").count() == engine.tables.crates().count()


def test_bundle_is_compressed(spark, tmp_path):
    write_bundle(tables.Tables(spark, "/root/testdata/sf0.001"), str(tmp_path / "bundle"))
    files = list((tmp_path / "bundle").glob("section=*/part-*"))
    assert files and all(f.name.endswith(".gz") for f in files)
    assert sum(f.stat().st_size for f in files) < 0.5 * sum(len(r.json.encode()) + 1 for r in read_bundle(spark, str(tmp_path / "bundle")).collect())
