"""The six chunk types in one form, for search, rerank and display."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import text
from lodestrata.functions.hashing import chunk_id
from lodestrata.operators import summaries
from lodestrata.operators.intent import TYPES
from lodestrata.runtime import cut_lineage
from lodestrata.sources.tables import Tables

COLUMNS = ["id", "file_path", "identifier", "project", "line", "text", "embed_text", "rerank_text", "context"]
#: fixed values: headings of the sections of a context, in their order
SECTIONS = {"crate": "## Crate Structure", "folder": "## Relevant Folders", "file": "## Relevant Files", "module_doc": "## Module Documentation", "code": "## Relevant Code", "readme": "## Project Documentation"}
NOTHING = "No relevant code or documentation found."
MODULE_DOC_BYTES = 600


def none() -> Column:
    return F.lit(None).cast("string")


def _chunk(df: DataFrame, id: Column, path: str, identifier: Column, project: str, line: Column, body: Column, embedded: Column, reranked: Column, *shown: Column | str) -> DataFrame:
    return df.select(F.concat(F.lit("\n### "), *[F.lit(x) if isinstance(x, str) else x for x in shown], F.lit("\n")).alias("context"), id.alias("id"), F.col(path).alias("file_path"), identifier.alias("identifier"), F.col(project).alias("project"), line.cast("long").alias("line"), body.alias("text"), embedded.alias("embed_text"), reranked.alias("rerank_text")).select(*COLUMNS)


def module_docs(t: Tables) -> DataFrame:
    """(chunk_id, file_path, module_name, doc_content, project_name): the documents that are module documentation, by their source."""
    d = t.raw("documents").where("doc_kind = 'module_doc' and text is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.struct("text", "source", "project_name")).alias("r"))
    source = F.coalesce("r.source", F.lit("unknown"))
    path = F.concat(source, F.lit("/"), F.col("doc_id").cast("string"), F.lit("/lib.rs"))
    return d.select(chunk_id(path, F.col("r.text")).alias("chunk_id"), path.alias("file_path"), source.alias("module_name"), F.col("r.text").alias("doc_content"), F.coalesce("r.project_name", F.lit("unknown")).alias("project_name"))


def folders(t: Tables) -> DataFrame:
    """(chunk_id, folder_path, summary_text, project_name) of each folder of the code table."""
    code = t.code("file_path", "language", "signature", "identifier", "node_type", "project_name")
    owner = code.groupBy(F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1).alias("folder_path")).agg(F.min("project_name").alias("project_name"))
    found = summaries.folder_summary(code).join(owner, "folder_path")
    return found.select(chunk_id(F.col("folder_path"), F.col("summary_text")).alias("chunk_id"), "folder_path", "summary_text", "project_name")


def files(t: Tables) -> DataFrame:
    """(chunk_id, file_path, summary_text, project_name) of each file of the code table; imports are the names called in other files."""
    code = t.code("file_path", "language", "signature", "identifier", "node_type", "docstring", "start_line", "project_name")
    owner = code.groupBy("file_path").agg(F.min("project_name").alias("project_name"))
    imports = t.edges().where("caller_file <> callee_file").select(F.col("caller_file").alias("file_path"), F.col("callee_identifier").alias("imported_name"))
    found = summaries.file_summary(code, imports).join(owner, "file_path")
    return found.select(chunk_id(F.concat(F.lit("file:"), "file_path"), F.col("summary_text")).alias("chunk_id"), "file_path", "summary_text", "project_name")


def chunks(t: Tables, kind: str) -> DataFrame:
    """COLUMNS of one chunk type. text: what full-text search covers (null: nothing)."""
    c = F.col
    if kind == "code":
        d = t.code("file_path", "identifier", "project_name", "start_line", "searchable_text", "signature", "language", "docstring", "code_content")
        return _chunk(d, c("chunk_id"), "file_path", c("identifier"), "project_name", c("start_line"), c("searchable_text"), c("searchable_text"), text.rerank_text_code(c("signature"), c("identifier"), c("language"), c("docstring"), c("code_content")),
            "`", c("identifier"), "` in ", c("project_name"), " (", c("file_path"), ":", c("start_line").cast("string"), ")\n", F.when(c("docstring").isNotNull(), F.concat(F.lit("**Docs:** "), c("docstring"), F.lit("\n"))).otherwise(""), "```", c("language"), "\n", F.trim(c("code_content"), F.lit(" \t\n\r")), "\n```")
    if kind == "readme":
        d = t.readme("file_path", "project_name", "content")
        return _chunk(d, c("chunk_id"), "file_path", none(), "project_name", F.lit(None), c("content"), text.embed_text_readme(c("project_name"), c("content")), text.rerank_text_readme(c("project_name"), c("content")), c("project_name"), "\n", text.truncate_words(c("content"), text.CONTEXT_README_BYTES))
    if kind == "crate":
        said = text.crate_text(c("crate_name"), c("description"), c("dependencies"))
        return _chunk(t.crates(), c("chunk_id"), "crate_path", c("crate_name"), "project_name", F.lit(None), c("description"), said, said, "Crate `", c("crate_name"), "` (", c("project_name"), ")\n**Description:** ", F.coalesce("description", F.lit("No description available")), "\n**Local dependencies:** ", text.csv_or(c("dependencies"), "none"))
    if kind == "module_doc":
        said = text.module_doc_text(c("module_name"), c("doc_content"))
        return _chunk(module_docs(t), c("chunk_id"), "file_path", c("module_name"), "project_name", F.lit(None), c("doc_content"), said, said, "Module `", c("module_name"), "` (", c("project_name"), ")\n", text.truncate_words(c("doc_content"), MODULE_DOC_BYTES))
    if kind == "folder":
        return _chunk(folders(t), c("chunk_id"), "folder_path", none(), "project_name", F.lit(None), c("summary_text"), c("summary_text"), c("summary_text"), "`", c("folder_path"), "` (", c("project_name"), ")\n", c("summary_text"))
    if kind == "file":
        return _chunk(files(t), c("chunk_id"), "file_path", none(), "project_name", F.lit(None), c("summary_text"), c("summary_text"), c("summary_text"), "`", c("file_path"), "` (", c("project_name"), ")\n", c("summary_text"))
    raise ValueError(f"{kind!r} is none of {TYPES}")


def all_chunks(t: Tables) -> dict[str, DataFrame]:
    """All six types; summaries, which are derived, are written once since they are read several times."""
    return {k: cut_lineage(chunks(t, k)) if k in ("folder", "file") else chunks(t, k) for k in TYPES}


def rows_of(found: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """(id, vector) of chunks."""
    return found.select("id", embed(F.col("embed_text")).alias("vector"))


def docs_of(found: DataFrame) -> DataFrame:
    """(id, text) of the chunks that full-text search covers."""
    return found.where("text is not null").select("id", "text")
