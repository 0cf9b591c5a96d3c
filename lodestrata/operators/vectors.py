"""Exact nearest neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions.vectors import l2_distance
from lodestrata.runtime import ship_package


def knn(df: DataFrame, id_col: str, vector_col: str, query: list[float], k: int) -> DataFrame:
    """(id, distance): the k rows nearest to one vector by L2; null vectors take no part, ties go to the smaller id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    found = df.where(F.size(vector_col) == len(query)).select(F.col(id_col).alias("id"), l2_distance(F.col(vector_col), q).alias("distance"))
    return found.orderBy(F.round("distance", 9), "id").limit(k)


ROWS, QUERIES, AT_ONCE = 16_384, 32_768, 64


def blocks(n_r: int, n_q: int, block: int | None = None) -> tuple[int, int]:
    """Into how many blocks rows and queries are cut. Each side is sent once for each block of the other, so blocks are as large as a task can hold."""
    return max(1, -(-n_r // (block or ROWS))), max(1, -(-n_q // (block or QUERIES)))


def knn_batch(rows: DataFrame, queries: DataFrame, k: int, dim: int, block: int | None = None, sizes: tuple[int, int] | None = None) -> DataFrame:
    """(query_id, id, distance, rank) of each query's k nearest rows by L2.

    ``rows``: (id, vector); ``queries``: (query_id, vector). Both sides are cut
    into blocks; a cell compares one block of each, keeps k for each query, and
    the cells' results are merged. Vectors that are null or of another length
    take no part; ties go to the smaller id. sizes: how many rows and queries
    there are at most, where that is known; they are counted otherwise.
    """
    ship_package(rows.sparkSession)
    good = lambda d: d.where(F.size("vector") == dim)
    n_r, n_q = sizes or (good(rows).count(), good(queries).count())
    b_r, b_q = blocks(n_r, n_q, block)
    kind = "array<float>" if dict(rows.dtypes)["vector"] == dict(queries.dtypes)["vector"] == "array<float>" else "array<double>"
    cell = lambda a, b: (a * F.lit(b_q) + b).cast("long")
    own = lambda c, b: F.pmod(F.xxhash64(c), F.lit(b))
    left = good(rows).select(F.col("id").cast("string").alias("key"), "vector", own("id", b_r).alias("a")).select(F.lit(False).alias("asks"), "key", "vector", F.explode(F.sequence(F.lit(0), F.lit(b_q - 1))).alias("b"), "a")
    right = good(queries).select(F.col("query_id").cast("string").alias("key"), "vector", own("query_id", b_q).alias("b")).select(F.lit(True).alias("asks"), "key", "vector", "b", F.explode(F.sequence(F.lit(0), F.lit(b_r - 1))).alias("a"))
    both = left.unionByName(right).select("asks", "key", F.col("vector").cast(kind).alias("vector"), cell(F.col("a"), F.col("b")).alias("cell"))
    number = dict(rows.dtypes)["id"] != "string"

    def nearest(t: pa.Table) -> pa.Table:
        asks = t.column("asks").to_numpy()
        x = np.array(t.column("vector").combine_chunks().flatten(), np.float64).reshape(-1, dim)
        keys = np.array(t.column("key").to_pylist(), object)
        q, r = np.flatnonzero(asks), np.flatnonzero(~asks)
        place = np.empty(len(r), np.int64)  # of each row's id among all
        place[np.argsort(np.array([int(i) for i in keys[r]], np.int64) if number else keys[r].astype(str), kind="stable")] = np.arange(len(r))
        found = []
        xr = x[r]
        squares = (xr**2).sum(1)[None, :]
        for at in range(0, len(q) if len(r) else 0, AT_ONCE):
            part = q[at : at + AT_ONCE]
            d = np.sqrt(np.maximum((x[part] ** 2).sum(1)[:, None] - 2 * x[part] @ xr.T + squares, 0))
            last = np.partition(d, k - 1, axis=1)[:, k - 1] if k < d.shape[1] else np.full(len(part), np.inf)
            # all rows as near as the k-th, however many there are; their exact distances and ids settle ties
            i, j = np.nonzero(d <= (last * (1 + 1e-9) + 1e-5)[:, None])
            exact = np.sqrt(((x[part[i]] - x[r[j]]) ** 2).sum(1))
            order = np.lexsort((place[j], np.round(exact, 9), i))
            i, j, exact = i[order], j[order], exact[order]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < k
            found.append((keys[part[i[keep]]], keys[r[j[keep]]], exact[keep]))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [[], [], []]
        return pa.table({"q": pa.array(columns[0], pa.string()), "r": pa.array(columns[1], pa.string()), "distance": pa.array(columns[2], pa.float64())})

    found = both.groupBy("cell").applyInArrow(nearest, "q string, r string, distance double")
    typed = found.select(F.col("q").cast(dict(queries.dtypes)["query_id"]).alias("query_id"), F.col("r").cast(dict(rows.dtypes)["id"]).alias("id"), "distance")
    w = Window.partitionBy("query_id").orderBy(F.round("distance", 9), "id")
    return typed.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
