"""Evaluation of retrieval runs: hits, recall, reciprocal rank, percentiles, warnings.

``cases``: (case_id, kind, expected) with kind one of file, identifier,
chunk_type, project, excluded. ``retrieved``: (case_id, rank, chunk_type,
file_path, identifier, project, relevance).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matches() -> Column:
    """Whether a retrieved row meets an expectation: files by part of the path, the rest exactly."""
    e = F.col("expected")
    return (
        F.when(F.col("kind").isin("file", "excluded"), F.contains(F.col("file_path"), e))
        .when(F.col("kind") == "identifier", F.coalesce(F.col("identifier") == e, F.lit(False)))
        .when(F.col("kind") == "chunk_type", F.col("chunk_type") == e)
        .when(F.col("kind") == "project", F.col("project") == e)
    )


def hits(cases: DataFrame, retrieved: DataFrame, k: int | None) -> DataFrame:
    """(case_id, kind, expected, hit) over the first k rows, or all of them."""
    top = retrieved if k is None else retrieved.where(F.col("rank") <= k)
    wide = cases.distinct().join(top, "case_id", "left")
    return wide.groupBy("case_id", "kind", "expected").agg(F.coalesce(F.max(matches()), F.lit(False)).alias("hit"))


def recall(cases: DataFrame, retrieved: DataFrame, k: int | None) -> DataFrame:
    """(case_id, recall): share of a case's files and identifiers that were found."""
    both = hits(cases.where(F.col("kind").isin("file", "identifier")), retrieved, k)
    return both.groupBy("case_id").agg((F.sum(F.col("hit").cast("double")) / F.count("*")).alias("recall"))


def reciprocal_rank(cases: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(case_id, mrr): 1 by the first relevant rank, 0 if there is none."""
    wide = cases.where(F.col("kind").isin("file", "identifier")).distinct().join(retrieved, "case_id", "left")
    return wide.groupBy("case_id").agg(F.coalesce(1.0 / F.min(F.when(matches(), F.col("rank"))), F.lit(0.0)).alias("mrr"))


def relevant_counts(retrieved: DataFrame, k: int) -> DataFrame:
    return retrieved.where(F.col("rank") <= k).groupBy("case_id").agg(F.count_if(F.col("relevance") > 0.5).alias("relevant_count"))


def percentile(column: str, p: float) -> Column:
    """Nearest-rank percentile: a value that occurs, no interpolation."""
    return F.expr(f"percentile_disc({p}) within group (order by {column})")


def first_ranks(cases: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(case_id, kind, expected, first): the rank at which an expectation is first met, null if never."""
    wide = cases.distinct().join(retrieved, "case_id", "left")
    return wide.groupBy("case_id", "kind", "expected").agg(F.min(F.when(matches(), F.col("rank"))).alias("first"))


def case_metrics(cases: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(case_id, recall_5, recall_10, recall_pool, mrr), all from one pass over what was retrieved."""
    first = first_ranks(cases.where(F.col("kind").isin("file", "identifier")), retrieved)
    share = lambda met: F.avg(F.coalesce(met, F.lit(False)).cast("double"))
    return first.groupBy("case_id").agg(
        share(F.col("first") <= 5).alias("recall_5"), share(F.col("first") <= 10).alias("recall_10"), share(F.col("first").isNotNull()).alias("recall_pool"), F.coalesce(1.0 / F.min("first"), F.lit(0.0)).alias("mrr")
    )


def enough_relevant(wanted: DataFrame, retrieved: DataFrame, k: int) -> DataFrame:
    """(case_id, relevant_count, enough): ``wanted(case_id, min_relevant_results)``; rows of the first k with a relevance above one half. Without a wish any number is enough."""
    counts = wanted.join(relevant_counts(retrieved, k), "case_id", "left").withColumn("relevant_count", F.coalesce("relevant_count", F.lit(0)))
    return counts.select("case_id", "relevant_count", (F.col("relevant_count") >= F.coalesce("min_relevant_results", F.lit(0))).alias("enough"))


def never_found(cases: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(expected) files that no case of theirs found anywhere."""
    found = hits(cases.where("kind = 'file'"), retrieved, None)
    return found.groupBy("expected").agg(F.max("hit").alias("any")).where("not any").select("expected")


def slow(latencies: DataFrame, factor: float = 5.0) -> DataFrame:
    """Rows of ``latencies(case_id, ms)`` above ``factor`` times the upper median, if there are three or more."""
    row = latencies.agg(F.count("*").alias("n"), F.expr("percentile_disc(0.5) within group (order by ms)").alias("low"), F.expr("percentile_disc(0.5) within group (order by ms desc)").alias("high")).first()
    if row.n < 3 or not row.high:
        return latencies.where("false")
    return latencies.where(F.col("ms") > factor * row.high)


def invalid_cases(cases: DataFrame, intents: list[str], strict: bool = False) -> DataFrame:
    """(case_id, problem) of a dataset's ``(case_id, expected_intent)``: empty or repeated ids, unknown intents.

    strict: cases whose ``kinds`` (how many expectations they have) is 0 are a problem too.
    """
    empty = cases.where(F.coalesce(F.trim("case_id"), F.lit("")) == "").select("case_id", F.lit("empty id").alias("problem"))
    twice = cases.groupBy("case_id").agg(F.count("*").alias("n")).where("n > 1").select("case_id", F.lit("repeated id").alias("problem"))
    bad = cases.where(F.col("expected_intent").isNotNull() & ~F.col("expected_intent").isin(intents)).select("case_id", F.lit("unknown intent").alias("problem"))
    found = empty.unionByName(twice).unionByName(bad)
    if strict:
        found = found.unionByName(cases.where("kinds = 0").select("case_id", F.lit("no expectation").alias("problem")))
    return found.distinct()
