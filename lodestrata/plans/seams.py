"""Where models plug in: embedders and rerankers as Arrow batch functions, with stand-ins that need no model."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions.text import tokenize
from lodestrata.functions.vectors import sigmoid
from lodestrata.runtime import ship_package


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> np.ndarray: ...


class Reranker(Protocol):
    def __call__(self, queries: list[str], texts: list[str]) -> list[float]: ...


def hashing_embedder(texts: list[str], dim: int = 64) -> np.ndarray:
    """Bag of hashed words, length 1; the same on every machine."""
    out = np.zeros((len(texts), dim))
    for i, text in enumerate(texts):
        for word in (text or "").lower().split():
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            out[i, h % dim] += 1 if h >> 63 else -1
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norms == 0, 1, norms)


def lexical_reranker(queries: list[str], texts: list[str]) -> list[float]:
    """A logit from the share of the question's words that the text has."""
    out = []
    for q, t in zip(queries, texts):
        words = set((q or "").lower().split())
        out.append(8.0 * len(words & set((t or "").lower().split())) / max(1, len(words)) - 4.0)
    return out


def term_vector(text: Column, dim: int = 16) -> Column:
    """A stand-in embedder without Python: counts of hashed terms, of length 1 (all zero for a text without terms)."""
    bucket = F.transform(tokenize(text), lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 2), 16, 10).cast("int"), F.lit(dim)))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.aggregate(bucket, F.array_repeat(F.lit(0.0), dim), lambda acc, b: F.transform(acc, lambda x, i: x + F.when(i == b, 1.0).otherwise(0.0)), lambda acc: F.transform(acc, lambda x: x / F.greatest(norm(acc), F.lit(1.0))))


def lexical_score(query: Column, text: Column) -> Column:
    """A stand-in reranker without Python: a logit from the share of the question's terms that the text has."""
    terms = F.array_distinct(tokenize(query))
    return 8.0 * F.size(F.array_intersect(terms, tokenize(text))) / F.greatest(F.lit(1), F.size(terms)) - 4.0


def embed(text: Column, embedder: Embedder = hashing_embedder) -> Column:
    ship_package(SparkSession.getActiveSession())

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(list(embedder([x or "" for x in s])))

    return run(text)


def guarded(reranker: Callable) -> Callable[[Column, Column], Column]:
    """A reranker over lists as a Column function; a batch that it fails has no scores."""

    @F.pandas_udf("double")
    def logits(q: pd.Series, t: pd.Series) -> pd.Series:
        try:
            return pd.Series(reranker(list(q), list(t)), dtype="float64")
        except Exception:  # noqa: BLE001  whatever a model raises
            return pd.Series([None] * len(q), dtype="float64")

    return logits


def rerank(candidates: DataFrame, score: Callable[[Column, Column], Column], limit: int) -> DataFrame:
    """(query_id, id, score, rank): ``candidates(query_id, id, query, text)`` by the reranker's score, ties by id.

    score: question and text to a logit; :func:`guarded` makes one of a reranker over lists.
    """
    ship_package(candidates.sparkSession)
    scored = candidates.select("query_id", "id", sigmoid(score(F.col("query"), F.col("text"))).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
