"""Paths of repository files as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: directories that ingestion leaves out
IGNORED_DIRS = [".git", "target", "node_modules", "__pycache__", ".venv", "venv", ".idea", ".vscode", "dist", "build", "tests", "test"]
TEST_FILE = r"(?i)^(?:test_.*\.py|.*_test\.py|.*\.(?:test|spec)\.(?:ts|tsx|js)|.*_test\.go)$"

#: fixed values: file extensions by language
LANGUAGES = {"rust": ["rs"], "python": ["py"], "typescript": ["ts", "tsx", "js", "jsx"], "go": ["go"]}


def normalize_path(path: Column) -> Column:
    return F.regexp_replace(path, r"\\", "/")


def parts(path: Column) -> Column:
    return F.filter(F.split(path, r"[/\\]"), lambda x: x != "")


def basename(path: Column) -> Column:
    """The last non-empty part, '' if there is none."""
    return F.coalesce(F.get(F.reverse(parts(path)), F.lit(0)), F.lit(""))


def module_name(path: Column) -> Column:
    """The basename without its last extension; a leading dot starts no extension."""
    return F.regexp_replace(basename(path), r"^(.+)\.[^.]*$", "$1")


def folder_of(path: Column) -> Column:
    """What stands before the last slash, '' at the root."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def project_name(path: Column, override: str | None = None, repository: str | None = None) -> Column:
    """An override, else the first part of a path of two or more, else the repository, else ``unknown``."""
    split = F.split(path, "/")
    first = F.when(F.size(split) > 1, split[0])
    return F.coalesce(F.lit(override), first, F.lit(repository), F.lit("unknown"))


def skipped(path: Column) -> Column:
    """Whether ingestion leaves the file out: an ignored or hidden directory, or a test file by its name."""
    split = F.split(path, "/")
    hidden = F.exists(split, lambda x: x.isin(IGNORED_DIRS) | (x.startswith(".") & ~x.isin(".", "..")))
    return hidden | F.element_at(split, -1).rlike(TEST_FILE)


def language_of(path: Column) -> Column:
    extension = F.regexp_extract(path, r"\.([^./]+)$", 1)
    found = F.lit(None).cast("string")
    for language, extensions in LANGUAGES.items():
        found = F.when(extension.isin(extensions), language).otherwise(found)
    return found


def is_public(language: Column, signature: Column, identifier: Column) -> Column:
    """Rust: ``pub``; Python: no single leading underscore; TypeScript: ``export``; else public."""
    return (
        F.when(language == "rust", F.coalesce(F.ltrim(signature).startswith("pub "), F.lit(False)))
        .when(language == "python", ~identifier.startswith("_") | identifier.startswith("__"))
        .when(language == "typescript", F.coalesce(signature.rlike(r"(?:^|[^\p{L}\p{N}_])export(?:$|[^\p{L}\p{N}_])"), F.lit(False)))
        .otherwise(F.lit(True))
    )
