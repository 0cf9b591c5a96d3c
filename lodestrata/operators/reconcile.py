"""Incremental maintenance of keyed tables: diff by content hash, upsert, delete."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def file_index(rows: DataFrame, path_col: str = "file_path") -> DataFrame:
    """(path, content_hash, chunk_ids): the stored state of each file."""
    return rows.groupBy(F.col(path_col).alias("path")).agg(F.min("content_hash").alias("content_hash"), F.sort_array(F.collect_set("chunk_id")).alias("chunk_ids"))


def status(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status): unchanged, changed, new or deleted, by ``(path, content_hash)`` of either side."""
    a, b = (x.groupBy("path").agg(F.min("content_hash").alias("content_hash")) for x in (old, new))
    wide = a.alias("o").join(b.alias("n"), "path", "full_outer")
    before, after = F.col("o.content_hash"), F.col("n.content_hash")
    return wide.select("path", F.when(before.isNull(), "new").when(after.isNull(), "deleted").when(before == after, "unchanged").otherwise("changed").alias("status"))


def stats(statuses: DataFrame) -> DataFrame:
    """One row of counts."""
    return statuses.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("unchanged", "changed", "new", "deleted")])


def deletions(old: DataFrame, new: DataFrame) -> DataFrame:
    """(chunk_id) of stored chunks that the new state has no more."""
    return old.select("chunk_id").distinct().join(new.select("chunk_id"), "chunk_id", "left_anti")


@dataclass
class Diff:
    """status: (path, status). come: rows to put in. go: (key) of stored rows that are no more."""

    status: DataFrame
    come: DataFrame
    go: DataFrame


def reconcile(existing: DataFrame, incoming: DataFrame, path: str, key: str) -> Diff:
    """What has to change so that ``existing`` becomes ``incoming``, by content hash of each path.

    A path may have many rows (the chunks of a file, which share its hash), one
    (a file's, folder's or module's summary), or be a name (a crate's). Rows of
    unchanged paths stay as they are stored. A null path is one path.
    """
    keyed = lambda d: d.select(F.coalesce(F.col(path), F.lit("")).alias("path"), "content_hash")
    state = status(keyed(existing), keyed(incoming))
    at = F.coalesce(F.col(path), F.lit(""))
    of = lambda d, *which: d.withColumn("__path", at).join(state.where(F.col("status").isin(*which)).select(F.col("path").alias("__path")), "__path", "left_semi").select(d.columns)
    come = of(incoming, "new", "changed")
    # a chunk may have moved to another path, so what comes in never goes
    go = of(existing, "changed", "deleted").select(key).distinct().join(incoming.select(key), key, "left_anti")
    return Diff(state, come, go)


def upsert(existing: DataFrame, incoming: DataFrame, key: str, newest: str | None = None) -> DataFrame:
    """``existing`` with the rows of ``incoming`` put in by key; of several rows of one key the newest comes in.

    Rows with a null key name nothing that could be replaced: stored ones stay, incoming ones don't come in.
    """
    columns = existing.columns
    others = [c for c in columns if c != key]
    order = F.struct(*([F.col(newest)] if newest else []), *others)
    best = incoming.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*others), order).alias("r")).select(key, "r.*").select(columns)
    return existing.join(best, key, "left_anti").select(columns).unionByName(best)


def delete_where(existing: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is true go; null keeps a row."""
    return existing.where(~F.coalesce(condition, F.lit(False)))


def delete_ids(existing: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return existing.join(ids.select(key), key, "left_anti")


def incremental(existing: DataFrame, incoming: DataFrame, path_col: str = "file_path") -> DataFrame:
    """The table after an incremental run: changed and new files come in, chunks of changed and vanished files go.

    Rows of unchanged files stay as they are stored.
    """
    keyed = lambda d: d.select(F.col(path_col).alias("path"), "content_hash")
    state = status(keyed(existing), keyed(incoming))
    path = state.withColumnRenamed("path", path_col)
    stay = existing.join(path.where("status = 'unchanged'"), path_col, "left_semi")
    come = incoming.join(path.where("status in ('new', 'changed')"), path_col, "left_semi")
    return stay.unionByName(come)


def mixed_models(rows: DataFrame) -> DataFrame:
    """(embedding_model_version, rows) of a table; more than one row means that vectors can't be compared."""
    return rows.groupBy("embedding_model_version").agg(F.count("*").alias("rows"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
