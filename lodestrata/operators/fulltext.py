"""BM25 over a corpus of ``(id, text)``."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions.text import tokenize
from lodestrata.runtime import ship_package

K1, B = 1.2, 0.75
CELL_DOCS, CELL_QUERIES, CELL_TERMS, AT_ONCE = 32_768, 32_768, 2_000_000, 64
SLACK = 1e-8  # more than rounding can move a score
MATRIX, MATRIX_TERMS, GROUP = 30, 128, 64


def postings(docs: DataFrame) -> DataFrame:
    """(term, id, tf, doc_len): how often each term stands in each document; documents without terms have no rows."""
    tokens = docs.select("id", tokenize(F.col("text")).alias("tokens"))
    return tokens.select("id", F.size("tokens").alias("doc_len"), F.explode("tokens").alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"), F.first("doc_len").cast("long").alias("doc_len"))


def idf_table(docs: DataFrame) -> DataFrame:
    """(term, df): documents that have the term."""
    return docs.select(F.explode(F.array_distinct(tokenize(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def idf(n_docs: Column, df: Column) -> Column:
    """Positive for every df, an unseen term (df 0) included."""
    return F.log((n_docs - df + 0.5) / (df + 0.5) + 1)


def wanted_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, times): a term that a query repeats counts as often."""
    return queries.select("query_id", F.explode(tokenize(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))


def top(scores: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank), positive scores only; ties go to the smaller id."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return scores.where("score > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def score_cell(t: pa.Table, average: float, k: int | None, number: bool) -> Iterator[tuple[pa.Array, list, pa.DictionaryArray, np.ndarray]]:
    """Scores of the documents of a cell for its queries, some queries at a time: (query keys, how many documents each has, their keys as a dictionary, their scores).

    Rows: asks, key, terms, values, doc_len. A query has its terms' weights as
    values, a document their frequencies, or null where each term stands as
    often as it is listed. A document may be spread over rows. With k the best
    k of each query are left; ties go to the smaller id (number: ids are numbers).
    """
    q, d = t.filter(t.column("asks")), t.filter(pc.invert(t.column("asks")))
    if not len(q) or not len(d):
        return
    column = lambda x, name: x.column(name).combine_chunks()
    wanted = column(q, "terms").flatten().dictionary_encode()
    q_term, weight = wanted.indices.to_numpy(), column(q, "values").flatten().to_numpy()
    q_at = np.concatenate(([0], np.cumsum(pc.list_value_length(column(q, "terms")).to_numpy())))
    keys = pc.dictionary_encode(column(d, "key"), null_encoding="encode")
    ids, of_row = keys.dictionary, keys.indices.to_numpy()
    n = len(ids)
    place = np.empty(n, np.int64)  # of each id among all
    place[pc.sort_indices(pc.cast(ids, pa.int64()) if number else ids).to_numpy()] = np.arange(n)

    listed = pc.list_value_length(column(d, "terms")).to_numpy()
    term = pc.fill_null(pc.index_in(column(d, "terms").flatten(), value_set=wanted.dictionary), -1).to_numpy()
    known = np.flatnonzero(term >= 0)
    spot, back = np.unique(term[known].astype(np.int64) * n + np.repeat(of_row, listed)[known], return_inverse=True)
    counted = d.column("values").null_count == len(d)
    tf = np.bincount(back, weights=None if counted else column(d, "values").flatten().to_numpy()[known], minlength=len(spot)).astype(float)
    length = np.ones(n)
    length[of_row] = listed if counted else column(d, "doc_len").to_numpy()
    doc = spot % n
    part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * (length[doc] / average if average > 0 else 1.0)))
    begin = np.searchsorted(spot // n, np.arange(len(wanted.dictionary) + 1))
    # terms that many queries have and many documents: multiplied as a matrix, which is faster than to go through their documents
    here, asked = np.diff(begin), np.bincount(q_term, minlength=len(wanted.dictionary))
    usual = np.flatnonzero(here * asked * MATRIX > n * len(q))
    usual = usual[np.argsort(-(here * asked)[usual])][:MATRIX_TERMS]
    at_row = np.full(len(wanted.dictionary), -1)
    at_row[usual] = np.arange(len(usual))
    parts = np.zeros((len(usual), n))
    for i, j in enumerate(usual):
        own = slice(begin[j], begin[j + 1])
        parts[i, doc[own]] = part[own]
    groups = n // GROUP

    for at in range(0, len(q), AT_ONCE):
        to = min(at + AT_ONCE, len(q))
        own = slice(q_at[at], q_at[to])
        of, terms, weights = np.repeat(np.arange(to - at), np.diff(q_at[at : to + 1])), q_term[own], weight[own]
        matrix = at_row[terms] >= 0
        w = np.zeros((to - at, len(usual)))
        np.add.at(w, (of[matrix], at_row[terms[matrix]]), weights[matrix])
        score = w @ parts
        for i, j, x in zip(of[~matrix].tolist(), terms[~matrix].tolist(), weights[~matrix].tolist()):
            own = slice(begin[j], begin[j + 1])
            score[i][doc[own]] += x * part[own]
        low = np.zeros(to - at)
        if k is not None and groups >= k:  # the k-th greatest of the groups' best: k documents have as much
            tops = score[:, : groups * GROUP].reshape(to - at, groups, GROUP).max(2)
            low = np.partition(tops, groups - k, axis=1)[:, groups - k] - SLACK
        found = []
        for own, least in zip(score, low):
            hits = np.flatnonzero(own >= least if least > 0 else own)
            if k is not None:
                if k < len(hits):
                    # all documents as good as the k-th, however many there are; ids settle ties
                    last = np.partition(own[hits], len(hits) - k)[len(hits) - k]
                    hits = hits[own[hits] >= last - SLACK]
                hits = hits[np.lexsort((place[hits], -np.round(own[hits], 9)))[:k]]
            found.append((hits, own[hits]))
        hits = np.concatenate([x for x, _ in found])
        # all pairs name most documents again and again, the best few rarely
        named = pa.DictionaryArray.from_arrays(pa.array(hits, pa.int32()), ids) if k is None else ids.take(pa.array(hits)).dictionary_encode()
        yield column(q, "key")[at:to], [len(x) for x, _ in found], named, np.concatenate([x for _, x in found])


def blocks(n_docs: int, asked: int, average: float, k: int | None) -> tuple[int, int]:
    """Into how many blocks documents and queries are cut. Each side is repeated for each block of the other; long documents make smaller blocks, all pairs more tasks."""
    size = max(1, min(CELL_DOCS, int(CELL_TERMS / max(average, 1))) // (4 if k is None else 1))
    return max(1, -(-n_docs // size)), max(1, -(-asked // CELL_QUERIES))


def search(queries: DataFrame, docs: DataFrame, n_docs: int, average: float, k: int | None, asked: int | None = None) -> DataFrame:
    """(query_id, id, score) of the documents that share a term with a query; with k, of each query the best k at least.

    ``queries``: (query_id, terms, values), ``docs``: (id, terms, values,
    doc_len), as in :func:`score_cell`. Both sides are cut into blocks and a
    cell scores one block of each, so the scores, of which there are as many as
    pairs, are never shuffled. asked: how many queries there are at most, where
    that is known.
    """
    ship_package(queries.sparkSession)
    b_d, b_q = blocks(n_docs, queries.count() if asked is None else asked, average, k)
    cell = (F.col("a") * F.lit(b_q) + F.col("b")).cast("int").alias("cell")
    own = lambda c, b: F.pmod(F.xxhash64(c), F.lit(b)).cast("int")
    every = lambda b: F.explode(F.sequence(F.lit(0), F.lit(b - 1)))
    row = lambda asks, key, length: [F.lit(asks).alias("asks"), F.col(key).cast("string").alias("key"), F.col("terms"), F.col("values").cast("array<double>").alias("values"), length.cast("long").alias("doc_len")]
    left = docs.select(*row(False, "id", F.col("doc_len")), own("id", b_d).alias("a"), every(b_q).alias("b"))
    right = queries.select(*row(True, "query_id", F.lit(None)), own("query_id", b_q).alias("b"), every(b_d).alias("a"))
    both = left.unionByName(right).select("asks", "key", "terms", "values", "doc_len", cell)
    number = dict(docs.dtypes)["id"] != "string"

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for asking, sizes, ids, scores in score_cell(pa.Table.from_batches(list(batches)), average, k, number):
            lists = [asking, ids.dictionary, pa.array(np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)), ids.indices, pa.array(scores)]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists], names=["queries", "ids", "q", "r", "score"])

    # a key stands once in a row, however many pairs name it
    if k is None:  # the more pairs, the longer a cell: each is a task, whatever its number hashes to
        both = both.repartitionById(b_d * b_q, "cell")
    found = both.groupBy("cell").applyInArrow(pairs, "queries array<string>, ids array<string>, q array<int>, r array<int>, score array<double>")
    each = found.select("queries", "ids", "q", "r", F.posexplode("score").alias("n", "score"))
    key = lambda names, at: F.get(names, F.get(at, F.col("n")))
    return each.select(key("queries", "q").cast(dict(queries.dtypes)["query_id"]).alias("query_id"), key("ids", "r").cast(dict(docs.dtypes)["id"]).alias("id"), "score")


def weighted(wanted: DataFrame, frequencies: DataFrame, n_docs: int) -> DataFrame:
    """(query_id, terms, values): the terms of each query that documents have, with their weights. ``frequencies``: (term, df)."""
    known = wanted.join(frequencies, "term").select("query_id", F.struct("term", (F.col("times") * idf(F.lit(n_docs), F.col("df"))).alias("weight")).alias("w"))
    listed = known.groupBy("query_id").agg(F.array_sort(F.collect_list("w")).alias("w"))
    return listed.select("query_id", F.col("w.term").alias("terms"), F.col("w.weight").alias("values"))


@dataclass
class Corpus:
    """A corpus ``docs(id, text)`` that is read anew by each search; the two totals are scalars.

    A null text has no terms but counts as a document; ids are distinct.
    """

    docs: DataFrame
    n_docs: int
    average: float

    @classmethod
    def of(cls, docs: DataFrame) -> Corpus:
        row = docs.agg(F.count("*").alias("n"), F.avg(F.size(tokenize(F.col("text")))).alias("a")).first()
        return cls(docs, row.n, row.a or 0.0)

    def _search(self, queries: DataFrame, k: int | None, asked: int | None) -> DataFrame:
        asked = queries.count() if asked is None else asked
        none = F.lit(None)
        docs = self.docs.select("id", tokenize(F.col("text")).alias("terms"), none.alias("values"), none.alias("doc_len"))
        return search(weighted(wanted_terms(queries), idf_table(self.docs), self.n_docs), docs, self.n_docs, self.average, k, asked)

    def scores(self, queries: DataFrame, asked: int | None = None) -> DataFrame:
        """(query_id, id, score) of every document that shares a term with ``queries(query_id, query)``."""
        return self._search(queries, None, asked)

    def topk(self, queries: DataFrame, k: int, asked: int | None = None) -> DataFrame:
        return top(self._search(queries, k, asked), k)


BUCKETS, SLOTS = 64, 64  # slots in a bucket


def write_index(docs: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """The full-text index of ``docs(id, text)``: postings by bucket of the term, each term's frequency, and the totals.

    The frequency of a term is counted from documents, map side first, so a
    term that every document has costs one row for each task; it is kept apart,
    so that postings need not be joined.
    """
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    postings(docs).withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
    idf_table(docs).write.mode("overwrite").parquet(f"{folder}/terms")
    total = docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg(F.size(tokenize(F.col("text")))), F.lit(0.0)).alias("average"), F.lit(buckets).alias("buckets"))
    total.write.mode("overwrite").parquet(f"{folder}/totals")


@dataclass
class Index:
    """An index that :func:`write_index` wrote; a search reads only the buckets of its terms."""

    postings: DataFrame
    frequencies: DataFrame
    n_docs: int
    average: float
    buckets: int

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Index:
        row = spark.read.parquet(f"{folder}/totals").first()
        found = spark.read.parquet(f"{folder}/postings")
        # older indices have the frequency in each posting
        frequencies = found.groupBy("term").agg(F.max("df").alias("df")) if "df" in found.columns else spark.read.parquet(f"{folder}/terms")
        return cls(found, frequencies, row.n_docs, row.average, row.buckets)

    def _search(self, queries: DataFrame, k: int | None, asked: int | None) -> DataFrame:
        wanted = wanted_terms(queries)
        # postings of other terms go by a hash, of which there are too few values to shuffle for; score_cell drops what is left of them
        slot = F.pmod(F.xxhash64("term"), F.lit(self.buckets * SLOTS)).cast("int")
        slots = wanted.select(F.pmod(slot, F.lit(self.buckets)).alias("bucket"), slot.alias("slot")).distinct()
        found = self.postings.withColumn("slot", slot).join(F.broadcast(slots), ["bucket", "slot"], "left_semi")
        docs = found.select("id", F.array("term").alias("terms"), F.array("tf").alias("values"), "doc_len")
        return search(weighted(wanted, self.frequencies, self.n_docs), docs, self.n_docs, self.average, k, asked)

    def scores(self, queries: DataFrame, asked: int | None = None) -> DataFrame:
        return self._search(queries, None, asked)

    def topk(self, queries: DataFrame, k: int, asked: int | None = None) -> DataFrame:
        return top(self._search(queries, k, asked), k)
