"""Resolution of called names to chunks, in three tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions.hashing import edge_id

#: fixed values: how a module path may end as a file
SUFFIXES = [".rs", "/mod.rs", ".py", "/__init__.py", ".ts", ".tsx", "/index.ts", "/index.tsx"]


def import_path(source: Column) -> Column:
    """An import source as a path: leading crate, super and self steps dropped, separators as slashes."""
    return F.replace(F.replace(F.regexp_replace(source, "^(?:crate::|super::|self::)+", ""), F.lit("::"), F.lit("/")), F.lit("."), F.lit("/"))


def import_matches(path: Column, source: Column) -> Column:
    """Whether a file may be what an import source names."""
    p = import_path(source)
    hit = F.contains(path, p)
    for suffix in SUFFIXES:
        hit = hit | F.endswith(path, F.concat(p, F.lit(suffix)))
    return hit


#: lengths of the parts of paths that imports and files are joined on
ANCHORS = (24, 8, 2)


def import_anchor(path: Column) -> Column:
    """The end of an import path that a file's path must hold; '' where it is too short to tell."""
    out = F.lit("")
    for n in reversed(ANCHORS):
        out = F.when(F.length(path) >= n, F.right(path, F.lit(n))).otherwise(out)
    return out


def file_anchors(path: Column) -> Column:
    """All parts of a file's path that an import's anchor can be, each once."""

    def parts(n: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.length(path) - n + 1), lambda i: F.substr(path, i, F.lit(n)))
        return F.when(F.length(path) >= n, every).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*map(parts, ANCHORS), F.array(F.lit(""))))


def last_imports(imports: DataFrame) -> DataFrame:
    """(file_path, imported_name, source_path): of several imports of a name in a file the last one, by ``position``."""
    return imports.groupBy("file_path", "imported_name").agg(F.max_by("source_path", F.struct("position", "source_path")).alias("source_path"))


def candidates(chunks: DataFrame, calls: DataFrame) -> DataFrame:
    """(caller, callee_identifier, caller_file, callee, callee_file): chunks with a called name, the caller itself left out.

    ``chunks``: (chunk_id, identifier, file_path); ``calls``: (caller, callee_identifier).
    """
    who = chunks.select(F.col("chunk_id").alias("caller"), F.col("file_path").alias("caller_file"))
    what = chunks.select(F.col("chunk_id").alias("callee"), F.col("identifier").alias("callee_identifier"), F.col("file_path").alias("callee_file"))
    return calls.distinct().join(who, "caller").join(what, "callee_identifier").where("caller <> callee")


def resolve(chunks: DataFrame, calls: DataFrame, imports: DataFrame) -> DataFrame:
    """(edge_id, caller, callee, callee_identifier, tier): one edge at most for each call.

    Tier 1: the only candidate in the caller's file. Tier 2: the only one whose
    path fits the import of that name in the caller's file (the last import
    holds). Tier 3: the only one at all. ``imports``: (file_path, imported_name,
    source_path, position).

    The candidates of a name are never listed for each call: they are counted
    once for each name, for each name and file, and for each name and import,
    with the least and greatest id; a count of one, the caller set aside, tells
    the candidate. Imports meet the files of their name by equal parts of the
    paths, so a name that very many files define isn't compared with all of them.
    """
    named = chunks.select(F.col("identifier").alias("callee_identifier"), F.col("file_path").alias("file"), "chunk_id")
    who = chunks.select(F.col("chunk_id").alias("caller"), F.col("file_path").alias("caller_file"), F.col("identifier").alias("caller_name"))
    last = last_imports(imports).select(F.col("file_path").alias("caller_file"), F.col("imported_name").alias("callee_identifier"), F.col("source_path").alias("source"))

    def counted(df: DataFrame, keys: list[str], tier: int) -> DataFrame:
        return df.groupBy(*keys).agg(F.count("*").alias(f"n{tier}"), F.min("chunk_id").alias(f"low{tier}"), F.max("chunk_id").alias(f"high{tier}"))

    by_file = counted(named, ["callee_identifier", "file"], 1)
    wanted = last.select("callee_identifier", "source").distinct().withColumn("anchor", import_anchor(import_path(F.col("source"))))
    files = by_file.join(wanted.select("callee_identifier").distinct(), "callee_identifier", "left_semi").withColumn("anchor", F.explode(file_anchors(F.col("file"))))
    fitting = wanted.join(files, ["callee_identifier", "anchor"]).where(import_matches(F.col("file"), F.col("source")))
    by_import = fitting.groupBy("callee_identifier", "source").agg(F.sum("n1").alias("n2"), F.min("low1").alias("low2"), F.max("high1").alias("high2"))
    by_file = by_file.withColumnRenamed("file", "caller_file")
    by_name = counted(named, ["callee_identifier"], 3)
    wide = calls.distinct().join(who, "caller").join(by_name, "callee_identifier").join(by_file, ["callee_identifier", "caller_file"], "left")
    wide = wide.join(last, ["caller_file", "callee_identifier"], "left").join(by_import, ["callee_identifier", "source"], "left")
    own = F.col("caller_name") == F.col("callee_identifier")
    among = {1: own, 2: own & F.coalesce(import_matches(F.col("caller_file"), F.col("source")), F.lit(False)), 3: own}

    def only(tier: int) -> Column:
        n, low, high = F.col(f"n{tier}"), F.col(f"low{tier}"), F.col(f"high{tier}")
        other = F.when(low == F.col("caller"), high).otherwise(low)
        return F.when(among[tier] & (n == 2), other).when(~among[tier] & (n == 1), low)

    best = wide.select("caller", "callee_identifier", *[only(t).alias(f"t{t}") for t in (1, 2, 3)])
    tier = F.when(F.col("t1").isNotNull(), 1).when(F.col("t2").isNotNull(), 2).when(F.col("t3").isNotNull(), 3)
    found = best.select("caller", F.coalesce("t1", "t2", "t3").alias("callee"), "callee_identifier", tier.alias("tier")).where("tier is not null")
    return found.select(edge_id(F.col("caller"), F.col("callee")).alias("edge_id"), "caller", "callee", "callee_identifier", "tier")


def dedup_definitions(chunks: DataFrame) -> DataFrame:
    """One chunk for each file, identifier and line; the smallest id stays."""
    w = Window.partitionBy("file_path", "identifier", "start_line").orderBy("chunk_id")
    return chunks.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
