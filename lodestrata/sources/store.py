"""A folder of keyed tables that ingestion writes: rows in buckets by key, so a change rewrites only the buckets it touches."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestrata.operators import reconcile as rec
from lodestrata.operators.fulltext import write_index
from lodestrata.runtime import cut_lineage
from lodestrata.sources.tables import check_schema_version, exists, read_text, write_text

BUCKET = "__bucket"


@dataclass(frozen=True)
class TableSpec:
    """key: what a row is replaced by. path: what reconcile compares (a file's path, or a crate's name). text: what full-text search covers."""

    key: str
    path: str | None
    text: str | None


#: fixed values: the tables, by name
SPECS = {
    "code_chunks": TableSpec("chunk_id", "file_path", "searchable_text"), "readme_chunks": TableSpec("chunk_id", "file_path", "content"), "crate_chunks": TableSpec("chunk_id", "crate_name", "description"),
    "module_doc_chunks": TableSpec("chunk_id", "file_path", "doc_content"), "folder_chunks": TableSpec("chunk_id", "folder_path", "summary_text"), "file_chunks": TableSpec("chunk_id", "file_path", "summary_text"),
    "call_edges": TableSpec("edge_id", None, None),
}


class ChunkStore:
    """Tables of SPECS below one folder. A table that doesn't exist yet has no rows; null keys aren't stored."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        check_schema_version(spark, self.folder)

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _schema(self, name: str) -> str:
        return f"{self.folder}/_schemas/{name}.json"

    def exists(self, name: str) -> bool:
        return exists(self.spark, self._schema(name))

    def _stored(self, name: str) -> DataFrame:
        """The table with its buckets; the schema is that of the first rows, so an emptied table has one too."""
        schema = StructType.fromJson(json.loads(read_text(self.spark, self._schema(name))))
        if not exists(self.spark, self.path(name)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path(name))

    def read(self, name: str, like: DataFrame | None = None) -> DataFrame:
        if self.exists(name):
            return self._stored(name).drop(BUCKET)
        if like is None:
            raise FileNotFoundError(self.path(name))
        return like.limit(0)

    def _bucket(self, name: str) -> Column:
        return F.pmod(F.xxhash64(SPECS[name].key), F.lit(self.buckets)).cast("int")

    def _replace(self, name: str, rows: DataFrame) -> None:
        """Write whole buckets; buckets that ``rows`` hasn't stay as they are."""
        rows.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path(name))

    def upsert(self, name: str, rows: DataFrame, newest: str | None = None) -> None:
        """Rows put in by key; running it again changes nothing. Only the buckets that get rows are read and written."""
        key = SPECS[name].key
        fresh = cut_lineage(rows.where(F.col(key).isNotNull()).withColumn(BUCKET, self._bucket(name)))
        touched = [r[0] for r in fresh.select(BUCKET).distinct().collect()]  # no more than there are buckets
        if not touched:
            return
        if self.exists(name):
            stored = self._stored(name).where(F.col(BUCKET).isin(touched))
            fresh = rec.upsert(stored.select(fresh.columns), fresh, key, newest)
        else:
            fresh = rec.upsert(fresh.limit(0), fresh, key, newest)
        fresh = cut_lineage(fresh)
        self._replace(name, fresh)
        if not self.exists(name):
            kept = [c for c in fresh.columns if c != BUCKET]
            write_text(self.spark, self._schema(name), fresh.select(*kept, BUCKET).schema.json())

    def delete(self, name: str, condition: Column) -> None:
        """Rows for which the condition is true go; a table that isn't there has none."""
        if not self.exists(name):
            return
        stored = self._stored(name)
        hit = F.coalesce(condition, F.lit(False))
        touched = [r[0] for r in stored.where(hit).select(BUCKET).distinct().collect()]
        self._keep(name, stored.where(F.col(BUCKET).isin(touched)), lambda d: d.where(~hit), touched)

    def delete_ids(self, name: str, ids: DataFrame) -> None:
        """Rows whose key is among ``ids``' only column go."""
        if not self.exists(name):
            return
        key = SPECS[name].key
        gone = cut_lineage(ids.toDF(key).where(F.col(key).isNotNull()).distinct().withColumn(BUCKET, self._bucket(name)))
        touched = [r[0] for r in gone.select(BUCKET).distinct().collect()]
        stored = self._stored(name).where(F.col(BUCKET).isin(touched))
        self._keep(name, stored, lambda d: d.join(gone.select(key), key, "left_anti").select(d.columns), touched)

    def _keep(self, name: str, stored: DataFrame, what, touched: list[int]) -> None:
        if not touched:
            return
        left = cut_lineage(what(stored))
        self._replace(name, left)
        # a bucket that lost its last row isn't overwritten, so its folder goes
        empty = set(touched) - {r[0] for r in left.select(BUCKET).distinct().collect()}
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        for b in empty:
            folder = hadoop.Path(f"{self.path(name)}/{BUCKET}={b}")
            folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

    def index(self, name: str) -> None:
        """The full-text index of a table, beside it."""
        spec = SPECS[name]
        rows = self.read(name).where(F.col(spec.text).isNotNull())
        write_index(rows.select(F.col(spec.key).alias("id"), F.col(spec.text).alias("text")), f"{self.folder}/_fulltext/{name}")

    def file_index(self) -> DataFrame:
        """(table, path, content_hash, chunk_ids) of everything stored."""
        parts = [rec.file_index(self.read(n), s.path).select(F.lit(n).alias("table"), "path", "content_hash", "chunk_ids") for n, s in SPECS.items() if s.path and self.exists(n)]
        return rec.union_all(parts)


def check_model(store: ChunkStore, name: str, model: str) -> None:
    """Refuse to mix vectors of several models in one table."""
    if store.exists(name):
        others = store.read(name).where(F.col("embedding_model_version") != model).select("embedding_model_version").limit(1).collect()
        if others:
            raise ValueError(f"{name} has vectors of {others[0][0]!r}, not of {model!r}; ingest it anew")


def ingest_full(store: ChunkStore, tables: dict[str, DataFrame], edges: DataFrame | None = None) -> None:
    """The projects of ``tables`` anew: their rows go, the given ones come in, indices are rebuilt, edges replaced."""
    for name, rows in tables.items():
        # the projects may be very many, so their old rows are found by a join
        if store.exists(name):
            stored = store.read(name)
            gone = stored.join(rows.select("project_name").distinct(), "project_name", "left_semi").select(SPECS[name].key)
            store.delete_ids(name, gone.join(rows.select(SPECS[name].key), SPECS[name].key, "left_anti"))
        store.upsert(name, rows)
        if store.exists(name):
            store.index(name)
    if edges is not None:
        persist_edges(store, edges)


def ingest_incremental(store: ChunkStore, tables: dict[str, DataFrame], edges: DataFrame | None = None, model: str | None = None, dry_run: bool = False) -> dict[str, DataFrame]:
    """Only what changed: new and changed paths come in, chunks that are no more go. Returns each table's (path, status).

    A dry run stops after the comparison. Edges are replaced even if nothing changed.
    """
    found = {}
    for name, rows in tables.items():
        if model is not None:
            check_model(store, name, model)
        diff = rec.reconcile(store.read(name, rows), rows, SPECS[name].path, SPECS[name].key)
        found[name] = cut_lineage(diff.status)
        if dry_run:
            continue
        come, go = cut_lineage(diff.come), cut_lineage(diff.go)
        store.upsert(name, come)
        store.delete_ids(name, go)
        if store.exists(name):
            store.index(name)
    if edges is not None and not dry_run:
        persist_edges(store, edges)
    return found


def persist_edges(store: ChunkStore, edges: DataFrame) -> None:
    """The stored edges of the projects that ``edges`` belong to are replaced by them."""
    if store.exists("call_edges"):
        stored = store.read("call_edges")
        old = stored.join(edges.select("project_name").distinct(), "project_name", "left_semi").select("edge_id")
        store.delete_ids("call_edges", old.join(edges.select("edge_id"), "edge_id", "left_anti"))
    store.upsert("call_edges", edges)
