"""Pieces that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.runtime import ship_package


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def one_row_per_key(df: DataFrame, key: str, columns: list[str], newest: str | None = None) -> DataFrame:
    """One row for each non-null ``key``; of several the newest, then the greatest values.

    Copies are thinned out before the shuffle by the partial aggregation, so a
    key that holds a large share of all rows costs one row per map task.
    """
    order = ([newest] if newest else []) + [c for c in columns if c != key]
    best = F.max(F.struct(*[F.col(f"`{c}`") for c in order])).alias("__best")
    picked = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(best)
    return picked.select(*[(F.col("__key") if c == key else F.col(f"__best.`{c}`")).alias(c) for c in columns])


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` over single batches."""
    ship_package(df.sparkSession)

    def run(batches):
        for batch in batches:
            yield from fn(batch)

    return df.mapInArrow(run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x
