"""Keys and content hashes, byte for byte the same wherever they are computed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DERIVATION_VERSION = "v1"


def content_hash(text: Column) -> Column:
    """SHA-256 of the text with line ends as LF."""
    return F.sha2(F.replace(text, F.lit("\r\n"), F.lit("\n")), 256)


def chunk_id(path: Column, content: Column) -> Column:
    return content_hash(F.concat(F.lit("chunk:"), path, F.lit(":"), content))


def edge_id(caller: Column, callee: Column) -> Column:
    return content_hash(F.concat(F.lit("edge:"), caller, F.lit(":"), callee))


def file_hash(source: Column, parts: Column) -> Column:
    """Hash of a file: derivation version, source, and signature and docstring of each chunk in order.

    ``parts``: array of structs (signature, docstring).
    """
    each = F.transform(parts, lambda p: F.concat(F.lit(":sig:"), F.coalesce(p["signature"], F.lit("")), F.lit(":doc:"), F.coalesce(p["docstring"], F.lit(""))))
    return F.sha2(F.concat(F.lit(f"derivation:{DERIVATION_VERSION}:src:"), F.replace(source, F.lit("\r\n"), F.lit("\n")), F.array_join(each, "")), 256)
