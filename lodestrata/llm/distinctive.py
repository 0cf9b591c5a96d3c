"""How distinctive a term is for each record: log-odds with a Dirichlet prior.

For a term the odds within a record are set against the odds in all other
records. An informative prior, the collection's own counts scaled down to
``prior_tokens`` pseudo tokens, steadies both; the difference of the log-odds
divided by its standard error is the z-score (Monroe, Colaresi and Quinn 2008).

Collection counts come from every record: each map task sums its own records
first, so one row for each task and term is shuffled. The most frequent terms
(at most ``hot_terms``, a fixed bound) are scored where the record is read;
only the others meet their counts in a join, and each of those is too rare to
make a partition hot.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.llm.common import arrow_map, one_row_per_key, read
from lodestrata.runtime import cut_lineage

TOKEN = re.compile(r"[^\W_]+")


def tokens_of(text: str) -> list[str]:
    """The longest runs of letters and digits of the lower-cased text."""
    return TOKEN.findall(text.lower())


def eligible(term: str, min_length: int) -> bool:
    return len(term) >= min_length and term[0].isalpha()


def term_statistics(docs: DataFrame, flush: int = 300_000) -> DataFrame:
    """(term, cf, df) over all rows of ``docs(id, text)``; the row of term '' has all tokens and all records."""

    def emit(cf: Counter, df: Counter, tokens: int, records: int) -> pa.RecordBatch:
        terms = ["", *cf]
        return pa.RecordBatch.from_pydict({"term": terms, "cf": pa.array([tokens, *cf.values()], pa.int64()), "df": pa.array([records, *(df[t] for t in cf)], pa.int64())})

    def partial(batches):
        cf, df, tokens, records = Counter(), Counter(), 0, 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                words = tokens_of(text or "")
                cf.update(words)
                df.update(set(words))
                tokens += len(words)
                records += 1
                if len(cf) >= flush:
                    yield emit(cf, df, tokens, records)
                    cf, df, tokens, records = Counter(), Counter(), 0, 0
        if records:
            yield emit(cf, df, tokens, records)

    return docs.mapInArrow(partial, "term string, cf long, df long").groupBy("term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))


def distinctive_terms(
    df: DataFrame,
    id_col: str,
    text_col: str,
    *,
    min_tf: int = 1,
    min_df: int = 1,
    max_df: int | None = None,
    min_length: int = 1,
    prior_tokens: float = 1000.0,
    hot_terms: int = 20_000,
) -> DataFrame:
    """(id, term, tf, cf, df, z) of each record's terms.

    tf: count in the record; cf: in all records; df: records that have it. z:
    the log-odds ratio of record against rest by its standard error. Terms are
    the tokens with at least ``min_length`` characters and a letter first; the
    bounds on tf and df only choose rows, the counts are over all records. A
    null or empty text has no terms, a null id no rows; an id that stands twice
    counts once, with its greatest text. A term of one record alone has no
    odds in the rest but the prior's, so its z is near 0.
    """
    docs = one_row_per_key(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", ["id", "text"])
    docs = docs.where(F.length("text") > 0)
    stats = cut_lineage(term_statistics(docs))
    total = stats.where("term = ''").agg(F.sum("cf")).first()[0] or 0
    usable = stats.where((F.length("term") >= max(1, min_length)) & (F.col("df") >= min_df))
    hottest = {r.term: (r.cf, r.df) for r in usable.orderBy(F.desc("df"), "term").limit(hot_terms).toLocalIterator()}
    if max_df is not None:
        usable = usable.where(F.col("df") <= max_df)
        hottest = {t: s for t, s in hottest.items() if s[1] > max_df}

    def candidates(batch: pa.RecordBatch):
        out: dict[str, list] = {c: [] for c in ("id", "term", "tf", "n", "cf", "df")}
        for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
            words = tokens_of(text)
            for term, tf in Counter(words).items():
                if tf >= min_tf and eligible(term, min_length):
                    known = hottest.get(term)
                    if known and max_df is not None:
                        continue
                    for c, v in zip(out, (key, term, tf, len(words), *(known or (None, None)))):
                        out[c].append(v)
        yield pa.RecordBatch.from_pydict({"id": pa.array(out["id"], batch.schema.field("id").type), "term": pa.array(out["term"], pa.string()), **{c: pa.array(out[c], pa.int64()) for c in ("tf", "n", "cf", "df")}})

    kind = dict(docs.dtypes)["id"]
    found = arrow_map(docs, candidates, f"id {kind}, term string, tf long, n long, cf long, df long")
    rare = found.where("cf is null").drop("cf", "df").join(usable, "term")
    scored = rare
    if max_df is None:
        hot = found.where("cf is not null")
        scored = rare.unionByName(hot)
    a, a0 = F.col("cf") * F.lit(prior_tokens / max(total, 1)), prior_tokens
    here, rest = F.col("tf") + a, F.col("cf") - F.col("tf") + a
    odds = F.log(here / (F.col("n") + a0 - here)) - F.log(rest / (F.lit(float(total)) - F.col("n") + a0 - rest))
    z = odds / F.sqrt(1 / here + 1 / rest)
    return scored.select("id", "term", "tf", "cf", "df", z.alias("z"))


def most_distinctive(scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` terms of each record with the greatest z, with their rank; equal ones go by the term."""
    w = Window.partitionBy("id").orderBy(F.desc(F.round("z", 9)), "term")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that mark a chunk: three times in it, in two to eight chunks, whatever their z."""
    terms = distinctive_terms(read(spark, sf_dir, "code_chunks"), "chunk_id", "code_content", min_tf=3, min_df=2, max_df=8, min_length=4)
    return terms.select(F.col("id").alias("chunk_id"), "term")


def p2_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """z of every term of four or more characters that stands twice or more in a chunk, in two chunks or more."""
    terms = distinctive_terms(read(spark, sf_dir, "code_chunks"), "chunk_id", "code_content", min_tf=2, min_df=2, min_length=4)
    return terms.select(F.col("id").alias("chunk_id"), "term", "tf", "cf", "df", F.round("z", 6).alias("z"))


def p2_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five terms that mark each chunk most, by z."""
    terms = distinctive_terms(read(spark, sf_dir, "code_chunks"), "chunk_id", "code_content", min_df=2, min_length=4)
    return most_distinctive(terms, 5).select(F.col("id").alias("chunk_id"), F.col("rank").cast("long").alias("rank"), "term", F.round("z", 6).alias("z"))


P2_SQL = r"""
with c as (select distinct chunk_id, lower(code_content) as t from code_chunks where chunk_id is not null),
w as (select chunk_id, unnest(regexp_split_to_array(t, '[^\p{L}\p{N}]+')) as term from c),
n as (select chunk_id, term, count(*) as tf from w where length(term) >= 4 and regexp_matches(term, '^\p{L}') group by all),
d as (select term, count(*) as df from n group by term)
select chunk_id, term from n join d using (term) where tf >= 3 and df between 2 and 8
"""
#: prior of 1,000 pseudo tokens in the collection's proportions, log-odds of chunk against rest, standard error, z
Z_SQL = r"""
with c as (select distinct chunk_id, lower(code_content) as t from code_chunks where chunk_id is not null),
w as (select chunk_id, term from (select chunk_id, unnest(regexp_split_to_array(t, '[^\p{L}\p{N}]+')) as term from c) where term <> ''),
l as (select chunk_id, count(*) as n from w group by chunk_id),
x as (select sum(n) as total from l),
f as (select chunk_id, term, count(*) as tf from w group by all),
s as (select term, sum(tf)::bigint as cf, count(*) as df from f group by term),
o as (select chunk_id, term, tf, cf, df, n, total::double as total, tf + cf * 1000 / total::double as here, cf - tf + cf * 1000 / total::double as rest
  from f join s using (term) join l using (chunk_id), x where length(term) >= 4 and regexp_matches(term, '^\p{L}') and df >= 2),
z as (select chunk_id, term, tf, cf, df, (ln(here / (n + 1000 - here)) - ln(rest / (total - n + 1000 - rest))) / sqrt(1 / here + 1 / rest) as z from o)
"""

QUERIES = {"p2_found": p2_found, "p2_scores": p2_scores, "p2_top": p2_top}
ORACLES = {
    "p2_found": P2_SQL,
    "p2_scores": Z_SQL + "select chunk_id, term, tf, cf, df, round(z, 6) as z from z where tf >= 2",
    "p2_top": Z_SQL + "select chunk_id, rank, term, round(z, 6) as z from (select *, row_number() over (partition by chunk_id order by round(z, 9) desc, term) as rank from z) where rank <= 5",
}
