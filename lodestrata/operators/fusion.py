"""Reciprocal rank fusion and what is built on it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RRF_K = 60


def rrf(lists: list[DataFrame], limit: int | None = None, k: int = RRF_K, by: list[str] | None = None) -> DataFrame:
    """(query_id, id, score, rank) from lists of (query_id, id, rank), ranks from 1; ties go to the smaller id."""
    by = by or ["query_id"]
    every = reduce(DataFrame.unionByName, [x.select(*by, "id", "rank") for x in lists])
    fused = every.groupBy(*by, "id").agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"))
    w = Window.partitionBy(*by).orderBy(F.desc(F.round("score", 9)), "id")
    ranked = fused.withColumn("rank", F.row_number().over(w))
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


def flatten(parts: DataFrame) -> DataFrame:
    """Ranks of all chunk types together: relevance down, path up, then type and id; ``parts``: (query_id, type_order, chunk_type, id, file_path, relevance)."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("relevance", 9)), "file_path", "type_order", "id")
    return parts.withColumn("rank", F.row_number().over(w))


def vote(candidates: DataFrame, top: int = 5) -> DataFrame:
    """(query_id, project_name) that most of the first ``top`` candidates have; ties go to the smaller name."""
    counts = candidates.where(F.col("rank") <= top).groupBy("query_id", "project_name").agg(F.count("*").alias("votes"))
    w = Window.partitionBy("query_id").orderBy(F.desc("votes"), "project_name")
    return counts.withColumn("n", F.row_number().over(w)).where("n = 1").select("query_id", "project_name", "votes")
