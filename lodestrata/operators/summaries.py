"""Summaries of files and folders, derived from their chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import paths
from lodestrata.functions.text import clean_purpose, csv_or

MAX_EXPORTS, MAX_KEYS = 16, 12
#: fixed values: syntax nodes that define types or functions; a file counts some more than a folder does
FOLDER_TYPES = ["struct_item", "enum_item", "trait_item", "type_item", "class_definition", "class_declaration", "interface_declaration", "type_alias_declaration", "enum_declaration", "type_spec"]
FOLDER_FUNCTIONS = ["function_item", "function_definition", "function_declaration", "method_definition"]
FILE_TYPES = [*FOLDER_TYPES, "type_declaration"]
FILE_FUNCTIONS = [*FOLDER_FUNCTIONS, "method_declaration"]


def sorted_first(items: Column, n: int) -> Column:
    return F.slice(F.sort_array(F.collect_set(items)), 1, n)


def file_purpose(chunks: DataFrame, module_docs: DataFrame | None = None) -> DataFrame:
    """(file_path, purpose): module documentation, else the first docstring by line, else a sentence with the module's name."""
    first = chunks.groupBy("file_path").agg(F.min_by("docstring", F.when(F.col("docstring").isNotNull(), F.struct("start_line", "chunk_id"))).alias("doc"))
    named = F.concat(F.lit("This file defines "), paths.module_name(F.col("file_path")), F.lit("."))
    if module_docs is None:
        return first.select("file_path", F.coalesce(clean_purpose(F.col("doc")), named).alias("purpose"))
    wide = first.join(module_docs.select("file_path", "doc_content"), "file_path", "left")
    return wide.select("file_path", F.coalesce(clean_purpose(F.col("doc_content")), clean_purpose(F.col("doc")), named).alias("purpose"))


def file_summary(chunks: DataFrame, imports: DataFrame) -> DataFrame:
    """(file_path, summary_text). ``imports``: (file_path, imported_name)."""
    public = paths.is_public(F.col("language"), F.col("signature"), F.col("identifier")) & F.col("node_type").isin(FILE_TYPES + FILE_FUNCTIONS)
    base = chunks.groupBy("file_path").agg(F.min("language").alias("language"), sorted_first(F.when(public, F.col("identifier")), MAX_EXPORTS).alias("exports"))
    named = imports.groupBy("file_path").agg(sorted_first(F.col("imported_name"), MAX_EXPORTS).alias("imports"))
    wide = base.join(named, "file_path", "left").join(file_purpose(chunks), "file_path")
    imported = F.coalesce("imports", F.array().cast("array<string>"))
    text = F.concat(
        F.lit("File: "), "file_path", F.lit(" (module: "), paths.module_name(F.col("file_path")), F.lit(", "), "language", F.lit(")\nExports: "), csv_or(F.col("exports"), "none"),
        F.lit("\nImports: "), csv_or(imported, "none"), F.lit("\nPurpose: "), "purpose",
    )
    return wide.select("file_path", text.alias("summary_text"))


def folder_summary(chunks: DataFrame) -> DataFrame:
    """(folder_path, file_count, summary_text) of each folder that holds files."""
    rows = chunks.withColumn("folder", paths.folder_of(F.col("file_path")))
    public = paths.is_public(F.col("language"), F.col("signature"), F.col("identifier"))
    base = rows.groupBy("folder").agg(
        F.countDistinct("file_path").alias("file_count"), F.sort_array(F.collect_set("language")).alias("languages"),
        sorted_first(F.when(public & F.col("node_type").isin(FOLDER_TYPES), F.col("identifier")), MAX_KEYS).alias("types"),
        sorted_first(F.when(public & F.col("node_type").isin(FOLDER_FUNCTIONS), F.col("identifier")), MAX_KEYS).alias("functions"),
    )
    below = rows.select("folder").distinct().where("folder <> ''").select(paths.folder_of(F.col("folder")).alias("folder"), paths.basename(F.col("folder")).alias("name"))
    subs = below.groupBy("folder").agg(F.sort_array(F.collect_set("name")).alias("subfolders"))
    wide = base.join(subs, "folder", "left")
    text = F.concat(
        F.lit("Folder: "), "folder", F.lit(" (module: "), paths.basename(F.col("folder")), F.lit(")\nContains: "), F.col("file_count").cast("string"), F.lit(" files ("), csv_or(F.col("languages"), "n/a"),
        F.lit(")\nKey types: "), csv_or(F.col("types"), "none"), F.lit("\nKey functions: "), csv_or(F.col("functions"), "none"),
        F.lit("\nSubfolders: "), csv_or(F.coalesce("subfolders", F.array().cast("array<string>")), "none"),
    )
    return wide.select(F.col("folder").alias("folder_path"), "file_count", text.alias("summary_text"))
