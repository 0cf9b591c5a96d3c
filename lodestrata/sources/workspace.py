"""A folder of repositories as chunk tables."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import hashing, paths
from lodestrata.runtime import ship_package
from lodestrata.sources import parsers


def walk(spark: SparkSession, root: str, sizes: bool = False) -> DataFrame:
    """(file_path, content) of all files that ingestion takes, or (file_path, n_bytes) without reading them.

    Paths are relative to ``root``; bytes that are no UTF-8 are replaced.
    """
    ship_package(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    prefix = root.rstrip("/") + "/"
    relative = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + prefix.replace(".", r"\."), "")
    body = F.col("length").alias("n_bytes") if sizes else F.make_valid_utf8(F.col("content").cast("string")).alias("content")
    return files.select(paths.normalize_path(relative).alias("file_path"), body).where(~paths.skipped(F.col("file_path")))


def readmes(files: DataFrame) -> DataFrame:
    found = files.where(F.lower(paths.basename(F.col("file_path"))) == "readme.md")
    return found.select(
        "file_path", paths.project_name(F.col("file_path")).alias("project_name"), "content",
        hashing.chunk_id(F.col("file_path"), F.col("content")).alias("chunk_id"), hashing.content_hash(F.col("content")).alias("content_hash"),
    )


def manifests(files: DataFrame) -> DataFrame:
    """(crate_name, crate_path, description, dependencies, project_name, chunk_id)."""

    def read(batches):
        for b in batches:
            rows = [(p, c, *m) for p, c in zip(b.file_path, b.content) if (m := parsers.manifest(c))]
            yield pd.DataFrame(rows, columns=["file_path", "content", "crate_name", "description", "dependencies"])

    found = files.where(paths.basename(F.col("file_path")) == "Cargo.toml").select("file_path", "content")
    parsed = found.mapInPandas(read, "file_path string, content string, crate_name string, description string, dependencies array<string>")
    return parsed.select("crate_name", paths.folder_of(F.col("file_path")).alias("crate_path"), "description", "dependencies", paths.project_name(F.col("file_path")).alias("project_name"), hashing.chunk_id(F.col("file_path"), F.col("content")).alias("chunk_id"))


def module_docs(files: DataFrame) -> DataFrame:
    """(file_path, module_name, doc_content, project_name, chunk_id) of crate roots with leading documentation."""
    found = files.where(paths.basename(F.col("file_path")) == "lib.rs")
    lines = F.split("content", "\n")
    stop = F.array_position(F.transform(lines, lambda x: x.startswith("//!")), False)
    head = F.when(stop == 0, lines).otherwise(F.slice(lines, 1, F.greatest(F.lit(0), stop.cast("int") - 1)))
    doc = F.trim(F.array_join(F.transform(head, lambda x: F.regexp_replace(x, "^//! ?", "")), "\n"))
    named = found.select("file_path", paths.basename(paths.folder_of(F.col("file_path"))).alias("module_name"), doc.alias("doc_content"), paths.project_name(F.col("file_path")).alias("project_name")).where("doc_content <> ''")
    return named.withColumn("chunk_id", hashing.chunk_id(F.col("file_path"), F.col("doc_content")))


CODE_SCHEMA = "file_path string, language string, content_hash string, identifier string, node_type string, code_content string, start_line long, docstring string, signature string, calls array<string>"


def file_hash(source: str, chunks: list) -> str:
    """As ``hashing.file_hash``: derivation version, source, signature and docstring of each chunk by identifier and line."""
    parts = [f":sig:{c.signature or ''}:doc:{c.docstring or ''}" for c in sorted(chunks, key=lambda c: (c.identifier, c.start_line))]
    text = f"derivation:{hashing.DERIVATION_VERSION}:src:" + source.replace("\r\n", "\n") + "".join(parts)
    return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()


def code_chunks(files: DataFrame) -> DataFrame:
    """The chunks of all source files, with the names they call; all chunks of a file share its hash.

    One pass: a file's hash is taken where it is parsed, so its text goes no further.
    """

    def parse(batches):
        for b in batches:
            rows = []
            for path, language, content in zip(b.file_path, b.language, b.content):
                found = parsers.chunks_of(content, language)
                whole = file_hash(content, found) if found else ""
                rows += [(path, language, whole, c.identifier, c.node_type, c.code_content, c.start_line, c.docstring, c.signature, c.calls) for c in found]
            yield pd.DataFrame(rows, columns=["file_path", "language", "content_hash", "identifier", "node_type", "code_content", "start_line", "docstring", "signature", "calls"])

    found = files.withColumn("language", paths.language_of(F.col("file_path"))).where("language is not null and content is not null").select("file_path", "language", "content")
    parsed = found.mapInPandas(parse, CODE_SCHEMA)
    return parsed.withColumn("project_name", paths.project_name(F.col("file_path"))).withColumn("chunk_id", hashing.chunk_id(F.col("file_path"), F.col("code_content")))


def imports(files: DataFrame) -> DataFrame:
    """(file_path, imported_name, source_path, position): position counts a file's imports in their order."""

    def parse(batches):
        for b in batches:
            rows = [(p, *i, n) for p, language, content in zip(b.file_path, b.language, b.content) for n, i in enumerate(parsers.imports_of(content, language))]
            yield pd.DataFrame(rows, columns=["file_path", "imported_name", "source_path", "position"])

    found = files.withColumn("language", paths.language_of(F.col("file_path"))).where("language is not null and content is not null").select("file_path", "language", "content")
    return found.mapInPandas(parse, "file_path string, imported_name string, source_path string, position long")


CASE = (
    "struct<id string, query string, expected_intent string, expected_files array<string>, expected_identifiers array<string>, "
    "expected_chunk_types array<string>, expected_projects array<string>, min_relevant_results int, excluded_files array<string>, tags array<string>, notes string>"
)
CASES_SCHEMA = f"description string, schema_version int, cases array<{CASE}>"


def _filled(cases: DataFrame) -> DataFrame:
    lists = [k for k, kind in cases.dtypes if kind.startswith("array")]
    return cases.withColumns({k: F.coalesce(k, F.array().cast("array<string>")) for k in lists})


def test_cases(spark: SparkSession, path: str) -> DataFrame:
    """The cases of a dataset file; missing lists are empty."""
    return _filled(spark.read.schema(CASES_SCHEMA).json(path, multiLine=True).select(F.explode("cases").alias("c")).select("c.*"))


def parsed_cases(texts: DataFrame) -> DataFrame:
    """The cases of ``texts(json)``, one dataset document a row; missing lists are empty, what is no JSON has no cases."""
    return _filled(texts.select(F.explode(F.from_json("json", CASES_SCHEMA)["cases"]).alias("c")).select("c.*"))
