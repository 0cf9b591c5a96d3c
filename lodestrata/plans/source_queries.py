"""Queries of the sources. The files are put together from the tables: each readme, manifests and module files written from
the crate and document tables, and source files joined from their chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.plans import chunk_types
from lodestrata.plans.sql import BY_100, CC, RC
from lodestrata.plans.search_queries import by_100
from lodestrata.sources import workspace
from lodestrata.sources.tables import Tables

QUERIES: dict = {}
ORACLES: dict = {}
c = F.col


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def sha(path: str, text: str) -> str:
    return f"sha256(replace('chunk:' || {path} || ':' || {text}, chr(13) || chr(10), chr(10)))"


FIRST = "case when contains({0}, '/') then split_part({0}, '/', 1) else 'unknown' end"


@query()
def src_walk(t: Tables) -> DataFrame:
    """The files of the table folder itself; only names and sizes are read."""
    return workspace.walk(t.spark, t.folder, sizes=True)


@query(f"with {RC}, f as (select * from rc where lower(regexp_extract(file_path, '([^/\\\\]*)[/\\\\]*$', 1)) = 'readme.md') select file_path, {FIRST.format('file_path')} as project_name, content, {sha('file_path', 'content')} as chunk_id, sha256(replace(content, chr(13) || chr(10), chr(10))) as content_hash from f")
def src_readme(t: Tables) -> DataFrame:
    return workspace.readmes(t.readme("file_path", "content").select("file_path", "content"))


def quoted(text):
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def manifest_files(t: Tables) -> DataFrame:
    """A Cargo.toml for each crate: name, description, path dependencies, and one registry dependency that counts for nothing."""
    deps = F.array_join(F.transform("dependencies", lambda d: F.concat(F.lit('"'), d, F.lit('" = { path = "../'), d, F.lit('" }\n'))), "")
    said = F.when(c("description").isNotNull(), F.concat(F.lit("description = "), quoted(c("description")), F.lit("\n"))).otherwise("")
    body = F.concat(F.lit('[package]\nname = "'), "crate_name", F.lit('"\n'), said, F.lit('\n[dependencies]\nserde = "1"\n'), deps)
    return t.crates().select(F.concat("crate_path", F.lit("/Cargo.toml")).alias("file_path"), body.alias("content"))


TOML = "'[package]' || chr(10) || 'name = \"' || crate_name || '\"' || chr(10) || case when description is not null then 'description = \"' || replace(replace(description, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"') || '\"' || chr(10) else '' end || chr(10) || '[dependencies]' || chr(10) || 'serde = \"1\"' || chr(10) || array_to_string(list_transform(dependencies, lambda d: '\"' || d || '\" = { path = \"../' || d || '\" }' || chr(10)), '')"


@query(f"select crate_name, crate_path, description, array_to_string(dependencies, ',') as dependencies, {FIRST.format("(crate_path || '/')")} as project_name, {sha("crate_path || '/Cargo.toml'", TOML)} as chunk_id from crate_chunks")
def src_manifest(t: Tables) -> DataFrame:
    return workspace.manifests(manifest_files(t)).withColumn("dependencies", F.array_join("dependencies", ","))


def module_files(t: Tables) -> DataFrame:
    """A lib.rs for each module document: the text as its leading documentation, then code."""
    d = chunk_types.module_docs(t)
    body = F.concat(F.lit("//! "), F.replace("doc_content", F.lit("\n"), F.lit("\n//! ")), F.lit("\n\nfn a() {}\n"))
    return d.select("file_path", body.alias("content"))


@query("""with f as (select coalesce(source, 'unknown') || '/' || doc_id || '/lib.rs' as file_path, doc_id::varchar as module_name, trim(text, ' ') as doc_content, coalesce(source, 'unknown') as project_name from documents where doc_kind = 'module_doc' and text is not null and doc_id is not null)
    select *, """ + sha("file_path", "doc_content") + """ as chunk_id from f where doc_content <> ''""")
def src_module_doc(t: Tables) -> DataFrame:
    return workspace.module_docs(module_files(t))


#: how each language imports a name
IMPORTS = {"rust": ("use crate::util::", ";"), "python": ("from util import ", ""), "typescript": ("import { ", ' } from "./util";'), "go": ('import "util/', '"')}


def source_files(t: Tables) -> DataFrame:
    """Source files: an import of the file's first name, then the code of its chunks by line, joined by blank lines."""
    code = t.code("file_path", "start_line", "code_content", "identifier", "language").groupBy("file_path").agg(
        F.min("language").alias("language"), F.min("identifier").alias("name"), F.array_sort(F.collect_list(F.struct("start_line", "chunk_id", "code_content"))).alias("parts")
    )
    head = F.lit("")
    for language, (before, after) in IMPORTS.items():
        head = F.when(c("language") == language, F.concat(F.lit(before), "name", F.lit(after))).otherwise(head)
    return code.select("file_path", F.concat(head, F.lit("\n\n"), F.array_join(F.transform("parts", lambda p: p["code_content"]), "\n\n")).alias("content"))


@query()
def src_code_chunks(t: Tables) -> DataFrame:
    return workspace.code_chunks(source_files(t))


@query()
def src_imports(t: Tables) -> DataFrame:
    return workspace.imports(source_files(t))


def case_texts(t: Tables) -> DataFrame:
    """A dataset document for each queried chunk, with one case that leaves most lists out."""
    case = F.struct(c("chunk_id").alias("id"), F.concat(F.lit("What calls "), "identifier", F.lit("?")).alias("query"), F.lit("relationship").alias("expected_intent"), F.array("file_path").alias("expected_files"), F.array(F.lit("graph")).alias("tags"))
    chosen = t.code("identifier", "file_path").where(by_100("chunk_id"))
    return chosen.select(F.to_json(F.struct(F.lit("cases").alias("description"), F.lit(1).alias("schema_version"), F.array(case).alias("cases"))).alias("json"))


@query(f"with {CC} select chunk_id as id, 'What calls ' || identifier || '?' as query, 'relationship' as expected_intent, file_path as expected_files, 0 as n_identifiers, 'graph' as tags from cc where {BY_100.format('chunk_id')}")
def src_testcases(t: Tables) -> DataFrame:
    found = workspace.parsed_cases(case_texts(t))
    return found.select("id", "query", "expected_intent", F.array_join("expected_files", ",").alias("expected_files"), F.size("expected_identifiers").alias("n_identifiers"), F.array_join("tags", ",").alias("tags"))
