"""The exported bundle: every chunk with its vector, edges, projects, prototypes and frequency tables, as JSON lines by section."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import searchable_text
from lodestrata.operators import intent
from lodestrata.operators.fulltext import Corpus, idf_table
from lodestrata.plans import chunk_types
from lodestrata.sources.tables import Tables

DROPPED = ["committed_at", "ingested_at", "searchable_text"]


def frequencies(t: Tables) -> DataFrame:
    """(corpus, term, df) of all six chunk types, over what full-text search covers."""
    parts = [idf_table(chunk_types.docs_of(d)).select(F.lit(k).alias("corpus"), "term", "df") for k, d in chunk_types.all_chunks(t).items()]
    return reduce(DataFrame.unionByName, parts)


def bundle_rows(t: Tables) -> DataFrame:
    """(section, json). Texts that are derived, as searchable_text is, are left to the reader."""

    def lines(name: str, df: DataFrame) -> DataFrame:
        return df.select(F.lit(name).alias("section"), F.to_json(F.struct("*")).alias("json"))

    code = t.code().drop(*DROPPED).join(t.vectors().withColumnsRenamed({"id": "chunk_id"}), "chunk_id", "left")
    parts = [
        lines("code", code), lines("readme", t.readme().drop(*DROPPED)), lines("crate", t.crates()), lines("module_doc", chunk_types.module_docs(t)), lines("folder", chunk_types.folders(t)), lines("file", chunk_types.files(t)),
        lines("edge", t.edges().select("caller", "callee", "tier")), lines("project", t.raw("code_chunks").select("project_name").distinct()), lines("prototype", intent.prototypes(t.spark)), lines("idf", frequencies(t)),
    ]
    return reduce(DataFrame.unionByName, parts)


def write_bundle(t: Tables, folder: str) -> None:
    """One folder of gzipped JSON lines for each section."""
    bundle_rows(t).write.mode("overwrite").partitionBy("section").text(folder, compression="gzip")


def read_bundle(spark: SparkSession, folder: str) -> DataFrame:
    """(json, section) as written."""
    return spark.read.text(folder).withColumnRenamed("value", "json")


CODE_SCHEMA = "chunk_id string, file_path string, language string, identifier string, node_type string, code_content string, start_line long, project_name string, docstring string, signature string, content_hash string, embedding_model_version string, vector array<double>"


@dataclass
class Bundle:
    """An opened bundle: code rows with their searchable text made anew, and vectors."""

    spark: SparkSession
    folder: str

    def section(self, name: str, schema: str) -> DataFrame:
        lines = self.spark.read.text(f"{self.folder}/section={name}")
        return lines.select(F.from_json("value", schema).alias("r")).select("r.*")

    def code(self) -> DataFrame:
        return self.section("code", CODE_SCHEMA).withColumn("searchable_text", searchable_text(F.col("identifier"), F.col("signature"), F.col("docstring")))

    def vectors(self) -> DataFrame:
        return self.code().where("vector is not null").select(F.col("chunk_id").alias("id"), "vector")

    def corpus(self) -> Corpus:
        return Corpus.of(self.code().select(F.col("chunk_id").alias("id"), F.col("searchable_text").alias("text")))

    def edges(self) -> DataFrame:
        return self.section("edge", "caller string, callee string, tier int")
