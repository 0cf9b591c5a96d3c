"""Runs of tokens that several pages of a host share, found with suffix arrays, and what is left without them.

The token streams of a host's pages are concatenated and their suffixes sorted
down to the length of the shortest run that counts. Neighbours in that order
with so long a common prefix are one run; where a run stands on enough distinct
pages, all its places are covered. Longer runs are unions of such places, so
nothing is lost by stopping there. Covered stretches go, unique ones stay.

A host with much text is split into shards. Shards tell each other, by hash and
fragment of the hash space, on how many of their pages a run stands; so a run
that has one page in each of several shards is found too.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import arrow_map, mix64, read
from lodestrata.llm.markup import blocks_of
from lodestrata.runtime import ship_package


@dataclass(frozen=True)
class RunParams:
    """least_tokens: length of the shortest run. least_pages: distinct pages of the host that make it boilerplate.

    shard_chars: characters that one shard of a host holds, more only for a
    single page. max_fragments: bound of the parts that shards of a host
    exchange their counts in.
    """

    least_tokens: int = 12
    least_pages: int = 3
    shard_chars: int = 16_000_000
    max_fragments: int = 4096


TOKEN = re.compile(r"[^\W_]+")


def windows(code: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes by their first ``length`` codes, and for each place the number of its prefix (equal ones the same).

    Prefix doubling: two sorted halves of a prefix give the order of the whole.
    """
    n = len(code)
    rank = np.unique(code, return_inverse=True)[1].astype(np.int64)
    have = 1
    while have < length:
        step = min(have, length - have)
        later = np.full(n, -1, np.int64)
        later[: max(0, n - step)] = rank[step:]
        pair = (rank << np.int64(32)) | (later + 1)
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        have += step
    return np.argsort(rank, kind="stable"), rank


def streams(pages: list[list[str]]) -> tuple[np.ndarray, np.ndarray, list[list[list[tuple[int, int]]]]]:
    """Codes of all tokens (a mark of its own ends each page), the page of each, and the spans of each block's tokens."""
    known: dict[str, int] = {}
    codes, owner, spans = [], [], []
    for number, blocks in enumerate(pages):
        spans.append([])
        for text in blocks:
            found = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
            spans[-1].append(found)
            codes.extend(known.setdefault(text[a:b].lower(), len(known)) for a, b in found)
            owner.extend([number] * len(found))
        codes.append(-1 - number)
        owner.append(number)
    return np.array(codes, np.int64), np.array(owner, np.int64), spans


def counted_runs(code: np.ndarray, owner: np.ndarray, p: RunParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of whole windows, the run at each, distinct pages of each run)."""
    n = len(code)
    if n < p.least_tokens:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    order, rank = windows(code, p.least_tokens)
    stops = np.flatnonzero(code < 0)
    whole = np.zeros(n, bool)
    at = np.arange(n)
    whole[:] = stops[np.searchsorted(stops, at)] - at >= p.least_tokens
    places = order[whole[order]]
    if not len(places):
        return places, places, places
    run = np.unique(rank[places], return_inverse=True)[1]
    by = np.lexsort((owner[places], run))
    new = np.append(True, (run[by][1:] != run[by][:-1]) | (owner[places][by][1:] != owner[places][by][:-1]))
    return places, run, np.bincount(run[by][new])


def run_hashes(texts_code: np.ndarray, names: np.ndarray, places: np.ndarray, run: np.ndarray, p: RunParams) -> np.ndarray:
    """A 64-bit hash of each run's tokens, the same in every shard. ``names``: hash of the token of each code."""
    first = np.unique(run, return_index=True)[1]
    value = np.zeros(len(first), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(p.least_tokens):
            value = mix64(value * np.uint64(0x100000001B3) + names[texts_code[places[first] + k]] + np.uint64(k + 1))
    return value


def token_hashes(pages: list[list[str]]) -> np.ndarray:
    """xxh3 of the tokens by the code that :func:`streams` gives them."""
    known: dict[str, int] = {}
    for blocks in pages:
        for text in blocks:
            for token in TOKEN.findall(text):
                low = token.lower()
                if low not in known:
                    known[low] = xxhash.xxh3_64_intdigest(low)
    return np.array(list(known.values()), np.uint64)


def kept(text: str, spans: list[tuple[int, int]], covered: np.ndarray) -> str | None:
    """The block without its covered stretches, each cut from its first token to the next one that stays; None if no token stays."""
    if not len(spans) or not covered.any():
        return text
    if covered.all():
        return None
    out, at = [], 0
    i = 0
    while i < len(spans):
        if covered[i]:
            j = i
            while j < len(spans) and covered[j]:
                j += 1
            out.append(text[at : spans[i][0]])
            at = spans[j][0] if j < len(spans) else len(text)
            i = j
        else:
            i += 1
    out.append(text[at:])
    return " ".join("".join(out).split())


PAGES = "host string, id string, kinds array<string>, texts array<string>"


def page_blocks(df: DataFrame, id_col: str, host_col: str, path_col: str, text_col: str) -> DataFrame:
    """(host, id, kinds, texts): the clean blocks of each page; null ids take no part, a null host is one host."""
    src = df.where(F.col(id_col).isNotNull()).select(F.col(f"`{id_col}`").cast("string").alias("id"), F.coalesce(F.col(f"`{host_col}`").cast("string"), F.lit("")).alias("host"), F.col(f"`{path_col}`").alias("path"), F.col(f"`{text_col}`").alias("text"))

    def clean(batch: pa.RecordBatch):
        found = [blocks_of(p, t) for p, t in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("id"), *[pa.array([[b[i] for b in f] for f in found], pa.list_(pa.string())) for i in (0, 1)]], names=["host", "id", "kinds", "texts"])

    return arrow_map(src.distinct(), clean, PAGES)


UNIQUE = "id string, position int, kind string, text string"


def unique_runs(pages: DataFrame, params: RunParams | None = None) -> DataFrame:
    """(id, position, kind, text): the blocks of ``pages(host, id, kinds, texts)`` without what enough pages of their host share.

    Blocks that are covered whole go; others keep their unique stretches; a
    block without tokens stays. Empty pages have no rows, nor has an empty
    table. An id that stands twice on a host with other blocks is two pages.
    """
    p = params or RunParams()
    ship_package(pages.sparkSession)
    size = F.aggregate("texts", F.lit(0).cast("long"), lambda a, t: a + F.length(t))
    # hosts with more text than a shard: no more than the whole text has shards
    large = pages.groupBy("host").agg(F.sum(size).alias("chars")).where(F.col("chars") > p.shard_chars).select("host", F.ceil(F.col("chars") / F.lit(p.shard_chars)).cast("int").alias("shards"))
    split = pages.join(F.broadcast(large), "host", "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
    split = split.withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards").cast("long")).cast("int"))

    def tell(table: pa.Table) -> pa.Table:
        """How many pages of this shard each run stands on, cut into fragments."""
        pages_ = table.column("texts").to_pylist()
        code, owner, _ = streams(pages_)
        places, run, count = counted_runs(code, owner, p)
        host, shard, shards = (table.column(c)[0].as_py() for c in ("host", "shard", "shards"))
        rows: dict[str, list] = {c: [] for c in ("host", "fragment", "shard", "runs", "counts")}
        if len(places):
            value = run_hashes(code, token_hashes(pages_), places, run, p)
            fragments = min(shards, p.max_fragments)
            fragment = (value % np.uint64(fragments)).astype(np.int64)
            for f in np.unique(fragment):
                pick = fragment == f
                for c, v in zip(rows, (host, int(f), shard, value[pick].tobytes(), count[pick].astype("<i4").tobytes())):
                    rows[c].append(v)
        return pa.Table.from_pydict(rows, schema=pa.schema([("host", pa.string()), ("fragment", pa.int32()), ("shard", pa.int32()), ("runs", pa.binary()), ("counts", pa.binary())]))

    def answer(table: pa.Table) -> pa.Table:
        """For each shard its runs that stand on enough pages of all shards together."""
        runs = [np.frombuffer(r, np.uint64) for r in table.column("runs").to_pylist()]
        value, back = np.unique(np.concatenate(runs), return_inverse=True)
        total = np.bincount(back, weights=np.concatenate([np.frombuffer(c, "<i4") for c in table.column("counts").to_pylist()]), minlength=len(value))
        often = total >= p.least_pages
        edge = np.cumsum([0, *map(len, runs)])
        return pa.table({"host": table.column("host"), "shard": table.column("shard"), "runs": pa.array([value[back[a:b]][often[back[a:b]]].tobytes() for a, b in zip(edge, edge[1:])], pa.binary())})

    told = split.where("shards > 1").groupBy("host", "shard").applyInArrow(tell, "host string, fragment int, shard int, runs binary, counts binary")
    answers = told.groupBy("host", "fragment").applyInArrow(answer, "host string, shard int, runs binary")

    def keep(table: pa.Table, answered: pa.Table) -> pa.Table:
        pages_, kinds, ids = (table.column(c).to_pylist() for c in ("texts", "kinds", "id"))
        code, owner, spans = streams(pages_)
        places, run, count = counted_runs(code, owner, p)
        covered = np.zeros(len(code), bool)
        if len(places):
            often = count >= p.least_pages
            if len(answered):
                known = np.concatenate([np.frombuffer(r, np.uint64) for r in answered.column("runs").to_pylist()])
                often |= np.isin(run_hashes(code, token_hashes(pages_), places, run, p), known)
            starts = places[often[run]]
            change = np.zeros(len(code) + 1, np.int64)
            np.add.at(change, starts, 1)
            np.add.at(change, starts + p.least_tokens, -1)
            covered = np.cumsum(change)[:-1] > 0
        out, at = [], 0
        for page, blocks in enumerate(pages_):
            for position, text in enumerate(blocks):
                n = len(spans[page][position])
                stays = kept(text, spans[page][position], covered[at : at + n])
                at += n
                if stays is not None:
                    out.append((ids[page], position, kinds[page][position], stays))
            at += 1
        types = (pa.string(), pa.int32(), pa.string(), pa.string())
        return pa.Table.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["id", "position", "kind", "text"])

    return split.groupBy("host", "shard").cogroup(answers.groupBy("host", "shard")).applyInArrow(keep, UNIQUE)


def p7_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of every readme without the runs that three or more readmes of its project share."""
    pages = page_blocks(read(spark, sf_dir, "readme_chunks"), "chunk_id", "project_name", "file_path", "content")
    return unique_runs(pages).select(F.col("id").alias("chunk_id"), "position", F.col("kind").alias("block_kind"), F.col("text").alias("block_text"))


QUERIES = {"p7_unique": p7_unique}
