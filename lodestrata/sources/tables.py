"""Chunk tables on Parquet: reading, the newest row of each key, schema versions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 1


def newest(df: DataFrame, key: str, by: str) -> DataFrame:
    """One row for each key, the one with the greatest ``by``; equal ones by their other values.

    Thinned out before the shuffle by partial aggregation.
    """
    others = [c for c in df.columns if c != key]
    order = F.struct(F.col(by), *[F.col(c) for c in others if c != by])
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(order).alias("r"))
    return best.select(*[(F.col(key) if c == key else F.col(f"r.{c}").alias(c)) for c in df.columns])


@dataclass
class Tables:
    """The tables of one folder, by name; chunk tables without their superseded rows."""

    spark: SparkSession
    folder: str

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def code(self, *columns: str) -> DataFrame:
        return self._chunks("code_chunks", columns)

    def readme(self, *columns: str) -> DataFrame:
        return self._chunks("readme_chunks", columns)

    def _chunks(self, name: str, columns: tuple[str, ...]) -> DataFrame:
        df = self.raw(name)
        wanted = list(dict.fromkeys(["chunk_id", *(columns or df.columns)]))
        return newest(df.select(*dict.fromkeys([*wanted, "ingested_at"])), "chunk_id", "ingested_at").select(*wanted)

    def crates(self) -> DataFrame:
        return self.raw("crate_chunks")

    def edges(self) -> DataFrame:
        """(caller, callee, tier, …) of the call graph, each edge once."""
        e = self.raw("call_edges").groupBy("edge_id").agg(*[F.min(c).alias(c) for c in ("caller_chunk_id", "callee_chunk_id", "caller_identifier", "callee_identifier", "caller_file", "callee_file", "project_name", "resolution_tier")])
        return e.withColumnsRenamed({"caller_chunk_id": "caller", "callee_chunk_id": "callee", "resolution_tier": "tier"})

    def vectors(self, field: str = "embedding") -> DataFrame:
        """(id, vector) of code chunks: the newest export of each, wrong lengths and invalid values left out."""
        v = newest(self.raw("code_embeddings").select("chunk_id", "exported_at", F.col(field).alias("vector")), "chunk_id", "exported_at")
        top, low = F.array_max("vector"), F.array_min("vector")
        good = (F.size("vector") == 64) & (F.size(F.array_compact("vector")) == 64) & ~F.isnan(top) & (F.abs(top) < float("inf")) & (F.abs(low) < float("inf")) & ((top != 0) | (low != 0))
        return v.where(good).select(F.col("chunk_id").alias("id"), "vector")


def _file(spark: SparkSession, path: str):
    """A path with its file system, whatever that is."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _file(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    p, fs = _file(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _file(spark, path)
    stream = fs.open(p)
    raw = bytes(stream.readAllBytes())
    stream.close()
    return raw.decode("utf-8", "replace")


def check_schema_version(spark: SparkSession, folder: str) -> int:
    """The version a table folder is stamped with; a fresh folder is stamped now, any other version is refused."""
    mark = f"{folder}/_schema_version"
    if not exists(spark, mark):
        write_text(spark, mark, str(SCHEMA_VERSION))
        return SCHEMA_VERSION
    text = read_text(spark, mark).strip()
    if not text.isdigit() or int(text) != SCHEMA_VERSION:
        raise ValueError(f"{folder} has schema version {text!r}, this library reads {SCHEMA_VERSION}")
    return int(text)
