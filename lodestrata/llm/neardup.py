"""Near-duplicate records with small edits: a set-similarity self-join by vertical partitioning.

Records are sets of word n-grams; two are near-duplicates from a Jaccard
similarity of ``threshold`` on. The join is exact and has three steps.

1. Which n-grams stand in more than one record? Each map task packs its
   n-grams, cut by hash into fragments, and each fragment answers with counts
   per record. A record whose share of such n-grams is below the threshold has
   no partner, so most records end here without their text moving again.
2. Records left over with equal sets are one class. The n-grams of the classes
   are put in one global order, rare ones first, and that order is cut into
   fragments. Every fragment counts, for itself, the overlaps of its segments
   of the records' prefixes; the partial overlaps are summed per pair. A pair
   goes on when the sum reaches what any similar pair must reach.
3. The whole sets of the pairs that go on are compared.

An n-gram that many classes share is spread over a grid of cells, block by
block of its records, so no task meets all of them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import arrow_map, mix64, one_row_per_key, read
from lodestrata.llm.distinctive import tokens_of
from lodestrata.runtime import cut_lineage, ship_package, shuffle_partitions


@dataclass(frozen=True)
class NearDupParams:
    """words: length of an n-gram. threshold: least Jaccard similarity.

    min_tokens: shorter records take no part. extension: how many n-grams the
    extended prefixes of a pair must share. hot: records that one cell of a
    shared n-gram holds. expand: None gives all pairs, however many records
    have equal sets. Where given, of a class of n equal sets with n * n beyond
    it only the first id is paired with other classes; each other record of it
    has one pair, with the first. block_records: records that a map task packs
    at a time.
    """

    words: int = 5
    threshold: float = 0.8
    min_tokens: int = 5
    extension: int = 2
    hot: int = 2048
    expand: int | None = None
    block_records: int = 32768
    records_per_fragment: int = 65536

    def needed(self, n):
        """Shared n-grams that a record of n distinct ones must have with any partner."""
        return np.ceil(self.threshold * np.asarray(n) - 1e-9).astype(np.int64)


class TokenHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = TokenHashes()


def ngrams_of(texts: list[str], p: NearDupParams) -> tuple[np.ndarray, np.ndarray]:
    """(record number, n-gram) of the distinct n-grams of each text, in that order; records with too few tokens have none."""
    parts, counts = [], []
    get = _HASHES.__getitem__
    for text in texts:
        words = tokens_of(text or "")
        counts.append(len(words))
        parts.extend(map(get, words))
    flat = np.array(parts, np.uint64)
    counts = np.array(counts, np.int64)
    if len(flat) < p.words:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    record = np.repeat(np.arange(len(texts)), counts)
    gram = np.zeros(len(flat) - p.words + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(p.words):
            gram = mix64(gram * np.uint64(0x100000001B3) + flat[i : i + len(gram)] + np.uint64(i + 1))
    whole = record[: len(gram)] == record[p.words - 1 :]
    whole &= counts[record[: len(gram)]] >= max(p.min_tokens, p.words)
    record, gram = record[: len(gram)][whole], gram[whole]
    order = np.lexsort((gram, record))
    record, gram = record[order], gram[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (record[1:] != record[:-1])
    return record[new], gram[new]


# --- step 1: records that can have a partner -------------------------------------------------

BLOB_SCHEMA = "cell long, block long, grams binary, places binary, ids array<string>, sizes binary, shared binary"
BLOB_ARROW = pa.schema([("cell", pa.int64()), ("block", pa.int64()), ("grams", pa.binary()), ("places", pa.binary()), ("ids", pa.list_(pa.string())), ("sizes", pa.binary()), ("shared", pa.binary())])
MANY = np.uint16(65535)


def planes(x: np.ndarray) -> bytes:
    """Bytes of the values' first bytes, then of their second ones and so on: compresses better."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def from_planes(raw: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(dtype).ravel()


def id_cell(block: int, fragments: int) -> int:
    """Where a block's ids wait for the answers: spread evenly, whatever the numbers of tasks and fragments."""
    return fragments + int(mix64(np.array([block], np.uint64))[0] % np.uint64(fragments))


def pack_block(block: int, ids: list[str], texts: list[str], fragments: int, p: NearDupParams) -> pa.RecordBatch:
    record, gram = ngrams_of(texts, p)
    size = np.bincount(record, minlength=len(ids))
    order = np.argsort(gram, kind="stable")
    gram, record = gram[order], record[order]
    new = np.ones(len(gram), bool)
    new[1:] = gram[1:] != gram[:-1]
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(gram)))
    shared = np.bincount(record[np.repeat(count > 1, count)], minlength=len(ids))
    gram = gram[start]
    place = np.where(count > 1, MANY, record[start].astype(np.uint16)).astype(np.uint16)
    # the fragment is the hash's leading part, 32 further bits stand for the n-gram
    scaled = (gram >> np.uint64(32)) * np.uint64(fragments)
    fragment, key = (scaled >> np.uint64(32)).astype(np.int64), ((scaled << np.uint64(32)) | (gram & np.uint64(0xFFFFFFFF))) >> np.uint64(32)
    key = key.astype(np.uint32)
    edge = np.searchsorted(fragment, np.arange(fragments + 1))
    out: dict[str, list] = {c: [] for c in BLOB_ARROW.names}
    for f in range(fragments):
        a, b = edge[f], edge[f + 1]
        if b > a:
            k = np.sort(key[a:b], kind="stable")
            at = np.argsort(key[a:b], kind="stable")
            for c, v in zip(out, (f, block, planes(np.diff(k, prepend=np.uint32(0)).astype(np.uint32)), planes(place[a:b][at]), None, None, None)):
                out[c].append(v)
    for c, v in zip(out, (id_cell(block, fragments), block, None, None, ids, size.astype("<i4").tobytes(), shared.astype("<i4").tobytes())):
        out[c].append(v)
    return pa.RecordBatch.from_pydict(out, schema=BLOB_ARROW)


def answer_fragment(table: pa.Table, fragments: int) -> pa.Table:
    """Per block, how many of each record's n-grams (alone in their block) other blocks have too."""
    if table.column("cell")[0].as_py() >= fragments:
        return table
    blocks = table.column("block").to_pylist()
    places = [from_planes(r, np.uint16) for r in table.column("places").to_pylist()]
    keys = [np.cumsum(from_planes(r, np.uint32), dtype=np.uint32) for r in table.column("grams").to_pylist()]
    key, place = np.concatenate(keys), np.concatenate(places)
    source = np.repeat(np.arange(len(blocks)), [len(k) for k in keys])
    order = np.argsort(key, kind="stable")
    k = key[order]
    twice = np.zeros(len(k), bool)
    twice[1:] = k[1:] == k[:-1]
    twice[:-1] |= k[:-1] == k[1:]
    hit = order[twice & (place[order] != MANY)]
    out: dict[str, list] = {c: [] for c in BLOB_ARROW.names}
    for i, block in enumerate(blocks):
        at = place[hit[source[hit] == i]].astype(np.int64)
        if len(at):
            counts = np.bincount(at)
            which = np.flatnonzero(counts)
            for c, v in zip(out, (-1, block, None, which.astype(np.uint16).tobytes(), None, None, counts[which].astype("<u4").tobytes())):
                out[c].append(v)
    return pa.Table.from_pydict(out, schema=BLOB_ARROW)


def judge_block(table: pa.Table, p: NearDupParams) -> pa.Table:
    ids, size, shared, more = None, None, None, []
    for row in table.select(["ids", "places", "sizes", "shared"]).to_pylist():
        if row["ids"] is not None:
            ids, size, shared = row["ids"], np.frombuffer(row["sizes"], "<i4"), np.frombuffer(row["shared"], "<i4").astype(np.int64)
        else:
            more.append((np.frombuffer(row["places"], np.uint16).astype(np.int64), np.frombuffer(row["shared"], "<u4")))
    for at, n in more:
        np.add.at(shared, at, n)
    keep = (size > 0) & (shared >= p.needed(size))
    return pa.table({"id": pa.array([ids[i] for i in np.flatnonzero(keep)], pa.string())})


def with_possible_partner(docs: DataFrame, fragments: int, p: NearDupParams) -> DataFrame:
    """The ids of ``docs(id, text)`` that step 1 leaves."""
    ship_package(docs.sparkSession)

    def pack(batches):
        task, seq, ids, texts = TaskContext.get().partitionId(), 0, [], []
        for batch in batches:
            ids += batch.column("id").to_pylist()
            texts += batch.column("text").to_pylist()
            while len(ids) >= p.block_records:
                yield pack_block((task << 24) | seq, ids[: p.block_records], texts[: p.block_records], fragments, p)
                ids, texts, seq = ids[p.block_records :], texts[p.block_records :], seq + 1
        if ids:
            yield pack_block((task << 24) | seq, ids, texts, fragments, p)

    blobs = docs.mapInArrow(pack, BLOB_SCHEMA)
    answers = blobs.groupBy("cell").applyInArrow(lambda t: answer_fragment(t, fragments), BLOB_SCHEMA)
    return answers.groupBy("block").applyInArrow(lambda t: judge_block(t, p), "id string")


# --- step 2: classes of equal sets, fragments of the global order ----------------------------


def classes_of(docs: DataFrame, p: NearDupParams) -> DataFrame:
    """(id, c1, c2, n, grams): the class of each record by 128 bits of its set."""

    def read_sets(batch: pa.RecordBatch):
        ids = batch.column("id").to_pylist()
        record, gram = ngrams_of(batch.column("text").to_pylist(), p)
        which, start = np.unique(record, return_index=True)
        parts = np.split(gram, start[1:]) if len(which) else []
        rows = {"id": [ids[i] for i in which], "c1": [], "c2": [], "n": [len(g) for g in parts], "grams": []}
        for g in parts:
            raw = g.tobytes()
            digest = xxhash.xxh3_128_intdigest(raw)
            rows["c1"].append((digest >> 64) - (1 << 63))
            rows["c2"].append((digest & ((1 << 64) - 1)) - (1 << 63))
            rows["grams"].append(g.view(np.int64))
        yield pa.RecordBatch.from_pydict({"id": pa.array(rows["id"], pa.string()), "c1": pa.array(rows["c1"], pa.int64()), "c2": pa.array(rows["c2"], pa.int64()), "n": pa.array(rows["n"], pa.int32()), "grams": pa.array(rows["grams"], pa.list_(pa.int64()))})

    return arrow_map(docs, read_sets, "id string, c1 long, c2 long, n int, grams array<long>")


def overlaps_in_fragment(table: pa.Table, p: NearDupParams) -> pa.Table:
    """(a1, a2, b1, b2, partial): n-grams of this fragment that two prefixes share, by pair."""
    c1, c2 = table.column("c1").to_numpy(), table.column("c2").to_numpy()
    both = np.stack([c1, c2], 1)
    record, idx = np.unique(both, axis=0, return_inverse=True)
    idx = idx.ravel()
    n, place = table.column("n").to_numpy(), table.column("place").to_numpy()
    gram, block, other = table.column("gram").to_numpy(), table.column("block").to_numpy(), table.column("other").to_numpy()
    order = np.lexsort((n, other, gram))
    edge = np.flatnonzero(np.append(True, (gram[order][1:] != gram[order][:-1]) | (other[order][1:] != other[order][:-1])))
    left, right = [], []
    for a, b in zip(edge, np.append(edge[1:], len(order))):
        if b - a < 2:
            continue
        at = order[a:b]
        sizes, places, blocks = n[at], place[at], block[at]
        across = other[at[0]] >> 32 != other[at[0]] & 0xFFFFFFFF
        # partners of i: larger or equal sets, up to n / threshold
        upto = np.searchsorted(sizes, sizes / p.threshold + 1e-9, side="right")
        for i in range(len(at) - 1):
            j = np.arange(i + 1, upto[i])
            if across:  # pairs of one block are counted in its own cell
                j = j[blocks[j] != blocks[i]]
            if not len(j):
                continue
            need = np.ceil((sizes[i] + sizes[j]) * (p.threshold / (1 + p.threshold)) - 1e-9)
            j = j[np.minimum(sizes[i] - places[i], sizes[j] - places[j]) + np.minimum(places[i], places[j]) >= need]
            left.append(np.full(len(j), idx[at[i]]))
            right.append(idx[at[j]])
    if not left:
        return pa.table({c: pa.array([], t) for c, t in zip(("a1", "a2", "b1", "b2", "partial"), [pa.int64()] * 4 + [pa.int32()])})
    x, y = np.concatenate(left), np.concatenate(right)
    lo, hi = np.minimum(x, y), np.maximum(x, y)
    pair, partial = np.unique(lo.astype(np.int64) * len(record) + hi, return_counts=True)
    a, b = record[pair // len(record)], record[pair % len(record)]
    return pa.table({"a1": a[:, 0], "a2": a[:, 1], "b1": b[:, 0], "b2": b[:, 1], "partial": partial.astype(np.int32)})


def class_pairs(sets: DataFrame, p: NearDupParams) -> DataFrame:
    """(a1, a2, b1, b2, similarity) of the similar classes of ``sets(c1, c2, n, grams)``."""
    spark = sets.sparkSession
    postings = sets.select("c1", "c2", "n", F.explode("grams").alias("gram"))
    df = postings.groupBy("gram").agg(F.count("*").alias("df"))
    common = cut_lineage(postings.join(df.where("df > 1"), "gram"))
    # place in the global order: rare n-grams first; those of one class alone come before all others
    key = F.struct("df", "gram")
    mine = common.groupBy("c1", "c2", "n").agg(F.array_sort(F.collect_list(key)).alias("all"))
    prefix = F.col("n") - F.ceil(F.lit(p.threshold) * F.col("n") - F.lit(1e-9)).cast("int") + F.lit(p.extension)
    alone = F.col("n") - F.size("all")
    segments = mine.select("c1", "c2", "n", alone.alias("alone"), F.posexplode(F.slice("all", 1, F.greatest(F.lit(0), prefix - alone))).alias("at", "g")).select(
        "c1", "c2", "n", (F.col("alone") + F.col("at")).cast("int").alias("place"), F.col("g.df").alias("df"), F.col("g.gram").alias("gram")
    )
    # cut the order into fragments: by frequency level, and within a level by hash
    levels = common.groupBy(F.floor(F.log2("df")).cast("int").alias("level")).agg(F.count("*").alias("n")).collect()
    width = max(1, 2 * sum(r.n for r in levels) // max(1, 4 * shuffle_partitions(spark)))
    width = min(max(width, 20_000), 200_000)
    cuts = {r.level: max(1, math.ceil(r.n / width)) for r in levels}
    level = F.floor(F.log2("df")).cast("int")
    cut = F.create_map(*[F.lit(x) for kv in sorted(cuts.items()) for x in kv]) if cuts else F.create_map(F.lit(0), F.lit(1))
    part = level.cast("long") * F.lit(1 << 32) + F.pmod(F.xxhash64("gram"), F.element_at(cut, level).cast("long"))
    # a hot n-gram's records form blocks; a cell takes two of them
    blocks = F.ceil(F.col("df") / F.lit(p.hot)).cast("int")
    block = F.pmod(F.xxhash64("c1", "c2"), blocks.cast("long")).cast("int")
    cells = segments.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    cells = cells.select(
        (part * F.lit(31) + F.when(blocks > 1, F.xxhash64("gram", low, high)).otherwise(F.lit(0))).alias("part"), "gram", "c1", "c2", "n", "place", "block", F.shiftleft(low.cast("long"), 32).bitwiseOR(high.cast("long")).alias("other")
    )
    partial = cells.groupBy("part").applyInArrow(lambda t: overlaps_in_fragment(t, p), "a1 long, a2 long, b1 long, b2 long, partial int")
    # short sets may have fewer n-grams in common than the extension asks
    summed = partial.groupBy("a1", "a2", "b1", "b2").agg(F.sum("partial").alias("partial"))
    side = lambda s: sets.select(F.col("c1").alias(f"{s}1"), F.col("c2").alias(f"{s}2"), F.col("n").alias(f"{s}n"), F.col("grams").alias(f"{s}g"))
    wide = summed.join(side("a"), ["a1", "a2"]).join(side("b"), ["b1", "b2"])
    least = F.ceil((F.col("an") + F.col("bn")) * F.lit(p.threshold / (1 + p.threshold)) - F.lit(1e-9))
    wide = wide.where(F.col("partial") >= F.least(F.lit(p.extension), least))
    both = F.size(F.array_intersect("ag", "bg"))
    similarity = both / (F.col("an") + F.col("bn") - both)
    return wide.withColumn("similarity", similarity).where(F.col("similarity") >= p.threshold - 1e-9).select("a1", "a2", "b1", "b2", "similarity")


@dataclass
class NearDuplicates:
    """members(id, c1, c2): the class of each record that can have a partner. links(a1, a2, b1, b2, similarity): similar classes."""

    members: DataFrame
    links: DataFrame
    params: NearDupParams

    def pairs(self) -> DataFrame:
        """(a, b, similarity) with a < b; see ``NearDupParams.expand`` for classes of copies."""
        members, star = self.members, None
        if self.params.expand is not None:
            size = members.groupBy("c1", "c2").agg(F.count("*").alias("n"), F.min("id").alias("first"))
            wide = members.join(size, ["c1", "c2"])
            left = (F.col("n") * F.col("n") > self.params.expand) & (F.col("id") != F.col("first"))
            members, star = wide.where(~left).select("id", "c1", "c2"), wide.where(left).select(F.col("first").alias("a"), F.col("id").alias("b"))
        side = lambda s: members.select(F.col("c1").alias(f"{s}1"), F.col("c2").alias(f"{s}2"), F.col("id").alias(f"{s}id"))
        apart = self.links.join(side("a"), ["a1", "a2"]).join(side("b"), ["b1", "b2"])
        apart = apart.select(F.least("aid", "bid").alias("a"), F.greatest("aid", "bid").alias("b"), "similarity")
        same = members.alias("x").join(members.alias("y"), ["c1", "c2"]).where("x.id < y.id").select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
        same = same if star is None else same.unionByName(star)
        return apart.unionByName(same.withColumn("similarity", F.lit(1.0)))


def near_duplicates(df: DataFrame, id_col: str, text_col: str, params: NearDupParams | None = None) -> NearDuplicates:
    """All links between near-duplicates of a table.

    A null id or text and texts below ``min_tokens`` have no links; an id that
    stands twice counts once, with its greatest text. Ids are compared as
    strings. Texts are taken whole; an empty table has no links.
    """
    p = params or NearDupParams()
    spark = df.sparkSession
    ship_package(spark)
    records = df.count()
    fragments = int(max(2 * shuffle_partitions(spark), math.ceil(records / p.records_per_fragment)))
    docs = one_row_per_key(df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")), "id", ["id", "text"]).where(F.col("text").isNotNull())
    left = docs.join(with_possible_partner(docs, fragments, p), "id", "left_semi")
    sets = cut_lineage(classes_of(left, p))
    one = sets.groupBy("c1", "c2").agg(F.min(F.struct("n", "grams")).alias("s")).select("c1", "c2", "s.n", "s.grams")
    return NearDuplicates(sets.select("id", "c1", "c2"), class_pairs(one, p), p)


def near_duplicate_groups(found: NearDuplicates) -> DataFrame:
    """(id, group_id, links): the connected component of each linked record, named by its smallest id.

    Labels of the classes' graph are pulled down to the smallest neighbour and
    then along the labels themselves, so chains shorten by half each round.
    """
    name = lambda a, b: F.concat_ws(":", a, b)
    pairs = found.links.select(name("a1", "a2").alias("a"), name("b1", "b2").alias("b"))
    member = found.members.select("id", name("c1", "c2").alias("node"))
    both = cut_lineage(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = cut_lineage(member.select("node").distinct().withColumn("label", F.col("node")))
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("low"))
        pulled = label.join(near.withColumnRenamed("a", "node"), "node", "left").select("node", F.least("label", F.coalesce("low", "label")).alias("to"), "label")
        jump = label.select(F.col("node").alias("to"), F.col("label").alias("far"))
        step = cut_lineage(pulled.join(jump, "to").select("node", F.least("to", "far").alias("label"), (F.least("to", "far") != F.col("label")).alias("moved")))
        label = step.select("node", "label")
        if step.where("moved").isEmpty():
            break
    size = member.groupBy("node").agg(F.count("*").alias("n"))
    near = both.join(size.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.sum("n").alias("near"))
    wide = member.join(label, "node").join(size, "node").join(near.withColumnRenamed("a", "node"), "node", "left")
    wide = wide.withColumn("links", F.col("n") - 1 + F.coalesce("near", F.lit(0)))
    first = wide.groupBy("label").agg(F.min("id").alias("group_id"))
    return wide.where("links > 0").join(first, "label").select("id", "group_id", "links")


CODE = NearDupParams(words=3, threshold=0.7, min_tokens=20)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks whose sets of three consecutive tokens are alike to 70 % or more."""
    found = near_duplicates(read(spark, sf_dir, "code_chunks"), "chunk_id", "code_content", CODE)
    return found.pairs().select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group and number of links of each chunk that has a near-duplicate."""
    return near_duplicate_groups(near_duplicates(read(spark, sf_dir, "code_chunks"), "chunk_id", "code_content", CODE))


#: brute force, for small tables
P3_SQL = r"""
with c as (select chunk_id, regexp_extract_all(lower(any_value(code_content)), '[\p{L}\p{N}]+') as w from code_chunks where chunk_id is not null group by chunk_id),
g as (select distinct chunk_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as gram from c where len(w) >= 20),
n as (select chunk_id, count(*) as n from g group by chunk_id),
rare as (select gram from g group by gram having count(*) > 1),
o as (select a.chunk_id as chunk_id_a, b.chunk_id as chunk_id_b, count(*) as shared from g a join g b using (gram) join rare using (gram) where a.chunk_id < b.chunk_id group by all)
select chunk_id_a, chunk_id_b from o join n x on x.chunk_id = chunk_id_a join n y on y.chunk_id = chunk_id_b where shared >= 0.7 * (x.n + y.n - shared)
"""

#: the same pairs, both ways, and all that can be reached over them
P3_GROUPS_SQL = (
    "with recursive pairs as (" + P3_SQL + """), e as (select chunk_id_a as a, chunk_id_b as b from pairs union all select chunk_id_b, chunk_id_a from pairs),
walk(id, other) as (select a, a from e union select walk.id, e.b from walk join e on e.a = walk.other),
named as (select id, min(other) as group_id from walk group by id)
select id, group_id, links from named join (select a as id, count(*) as links from e group by a) using (id)"""
)

QUERIES = {"p3_found": p3_found, "p3_groups": p3_groups}
ORACLES = {"p3_found": P3_SQL, "p3_groups": P3_GROUPS_SQL}
