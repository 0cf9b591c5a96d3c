"""Text as Columns: tokens, identifier splitting, searchable and embedding texts, truncation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_ALNUM = r"[^\p{L}\p{N}]+"
CAMEL_BOUNDARY = r"(?<=[^\p{Lu}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"
RERANK_CODE_BYTES, RERANK_README_BYTES, CONTEXT_README_BYTES, PURPOSE_CHARS = 1200, 1500, 800, 140


def tokenize(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order; null gives the empty array."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_ALNUM), lambda t: t != "")


def split_camel_case(identifier: Column) -> Column:
    """``parseHTTPResponse`` becomes ``parse http response``."""
    return F.lower(F.regexp_replace(identifier, CAMEL_BOUNDARY, " "))


def nonempty(c: Column) -> Column:
    return F.when(c != "", c)


def searchable_text(identifier: Column, signature: Column, docstring: Column) -> Column:
    """The identifier twice and, where that adds words, split; then signature and docstring."""
    split = split_camel_case(identifier)
    head = F.concat(identifier, F.lit(" "), identifier, F.when(split != F.lower(identifier), F.concat(F.lit(" "), split)).otherwise(F.lit("")))
    return F.concat_ws("\n", head, signature, nonempty(docstring))


def truncate_bytes(text: Column, limit: int, mark: str = "") -> Column:
    """At most ``limit`` bytes of UTF-8, no character cut in two; ``mark`` follows where something was cut."""
    cut = F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, limit).cast("string")), "\ufffd+$", "")
    return F.when(F.octet_length(text) > limit, F.concat(cut, F.lit(mark))).otherwise(text)


def truncate_words(text: Column, limit: int) -> Column:
    """At most ``limit`` bytes, cut at the last blank if there is one."""
    cut = truncate_bytes(text, limit)
    at_blank = F.regexp_extract(cut, r"(?s)^(.*) ", 1)
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.when(F.instr(cut, " ") > 0, at_blank).otherwise(cut))


def titled(signature: Column, identifier: Column, language: Column) -> Column:
    return F.concat(F.coalesce(signature, identifier), F.lit(" ("), language, F.lit(")"))


def rerank_text_code(signature, identifier, language, docstring, code) -> Column:
    return F.concat_ws("\n", titled(signature, identifier, language), nonempty(docstring), truncate_bytes(code, RERANK_CODE_BYTES, "..."))


def rerank_text_readme(project, content) -> Column:
    return F.concat(F.lit("Project: "), project, F.lit("\n"), truncate_bytes(content, RERANK_README_BYTES, "..."))


def crate_text(name, description, dependencies) -> Column:
    deps = F.when(F.size(dependencies) > 0, F.concat(F.lit("Dependencies: "), F.array_join(dependencies, ", ")))
    return F.concat_ws("\n", F.concat(F.lit("Crate: "), name), description, deps)


def embed_text_readme(project, content) -> Column:
    return F.concat(F.lit("Project: "), project, F.lit("\n"), content)


def module_doc_text(module, doc) -> Column:
    """Text of a module's documentation for embedding and rerank; summaries of files and folders stand for themselves."""
    return F.concat(F.lit("Module: "), module, F.lit("\n"), doc)


def embed_text_code(identifier, language, docstring, code, calls) -> Column:
    """Text of a chunk's body vector; the signature has a vector of its own."""
    called = F.when(F.size(calls) > 0, F.concat(F.lit("Calls: "), F.array_join(calls, ", ")))
    return F.concat_ws("\n", F.concat(identifier, F.lit(" ("), language, F.lit(")")), nonempty(docstring), code, called)


def embed_text_signature(signature, language, docstring) -> Column:
    return F.when(signature.isNotNull(), F.concat_ws("\n", F.concat(signature, F.lit(" ("), language, F.lit(")")), nonempty(docstring)))


def clean_purpose(text: Column) -> Column:
    """First line, white space collapsed, at most 140 characters; null if nothing is left."""
    line = F.element_at(F.split(text, r"\r?\n"), 1)
    return nonempty(F.left(F.trim(F.regexp_replace(line, r"\s+", " ")), F.lit(PURPOSE_CHARS)))


def tail_lines(text: Column, n: int) -> Column:
    lines = F.split(text, "\n")
    return F.array_join(F.slice(lines, F.greatest(F.lit(1), F.size(lines) - n + 1), F.lit(n)), "\n")


def csv_or(items: Column, fallback: str) -> Column:
    return F.when(F.size(items) > 0, F.array_join(items, ", ")).otherwise(F.lit(fallback))
