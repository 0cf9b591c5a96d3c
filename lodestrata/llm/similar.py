"""Most similar vectors for every vector: IVF with product-quantised residuals.

The collection is cut into lists by coarse centroids. Each list member keeps a
code of its residual (one byte per sub-vector). A query scans the lists nearest
to it with asymmetric distance tables (exact query against quantised member)
and reranks the survivors with exact cosines.

What is fitted (centroids and codebooks) comes from a bounded sample; every
row is indexed. Lists that lie close together share a work unit, so a query
travels once to a unit and not once to each list. A list that holds more rows
than a unit may is spread over a grid of units, block by block, so neither its
members nor its queries meet in one task. Exact copies of a vector are one
class: map tasks send a class once per batch, and ids come back at the end;
the ids of a class that holds a large share of all rows are salted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.llm.common import mix64, read
from lodestrata.runtime import ship_package, shuffle_partitions


@dataclass(frozen=True)
class SimilarityParams:
    """dim: length of a valid vector. k: neighbours wanted.

    min_similarity: where given, only neighbours at least this similar count;
    the quantisation error of each member then bounds which may be skipped, so
    the codes lose nothing. nprobe: lists a query scans, or, as a float, their share of all. refine: without
    min_similarity, refine * k members a unit are reranked for each query.
    train_rows: bound of the sample that centroids and codebooks are fitted on;
    least_train of it are always taken, beyond that four for each list.
    max_lists: bound of the lists, reached at about a thousand million rows.
    unit_rows: members a work unit may hold. hot_share: share of all rows from
    which on the ids of a class of copies are salted.
    """

    dim: int = 64
    k: int = 10
    min_similarity: float | None = None
    nprobe: int | float = 4
    refine: int = 5
    subvectors: int = 16
    train_rows: int = 262_144
    least_train: int = 16384
    unit_rows: int = 16384
    hot_share: float = 1 / 64
    iterations: int = 8
    seed: int = 7
    max_lists: int = 65_536

    def probes(self, lists: int) -> int:
        wanted = self.nprobe if isinstance(self.nprobe, int) else int(np.ceil(self.nprobe * lists))
        return max(1, min(lists, wanted))


@dataclass
class FieldModel:
    centroids: np.ndarray
    codebooks: np.ndarray
    #: list l has blocks[l] ** 2 units from first_unit[l] on: a grid of query blocks by member blocks
    first_unit: np.ndarray | None = None
    blocks: np.ndarray | None = None


def rows_at_a_time(lists: int) -> int:
    """Rows whose similarities with all lists fit in 64 MB."""
    return int(np.clip((1 << 24) // max(1, lists), 64, 4096))


def nearest(x: np.ndarray, c: np.ndarray, spherical: bool = True) -> np.ndarray:
    shift = 0 if spherical else 0.5 * (c * c).sum(1)
    step = rows_at_a_time(len(c))
    parts = [np.argmax(x[at : at + step] @ c.T - shift, axis=1) for at in range(0, len(x), step)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def coarse(x: np.ndarray, k: int, iterations: int, rng: np.random.Generator, flat: int = 4096) -> np.ndarray:
    """``k`` centroids on the unit sphere; beyond ``flat`` in two levels, so the work grows with k ** 1.5."""
    if k <= flat:
        return kmeans(x, k, iterations, rng, spherical=True)
    top = kmeans(x, int(np.sqrt(k)), iterations, rng, spherical=True)
    group = nearest(x, top)
    return np.concatenate([kmeans(x[group == g], max(1, round(k * (group == g).mean())), iterations, rng, spherical=True) for g in np.unique(group)])


def kmeans(x: np.ndarray, k: int, iterations: int, rng: np.random.Generator, spherical: bool) -> np.ndarray:
    k = max(1, min(k, len(x)))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(iterations):
        near = nearest(x, c, spherical)
        order = np.argsort(near, kind="stable")
        starts = np.searchsorted(near[order], np.arange(k))
        size = np.bincount(near, minlength=k)
        live = size > 0
        sums = np.zeros_like(c)
        sums[live] = np.add.reduceat(x[order], starts[live], axis=0)
        c[live] = sums[live] / size[live][:, None]
        if (~live).any():
            c[~live] = x[rng.choice(len(x), int((~live).sum()))]
        if spherical:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


def unit_vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and float32 values of the valid vectors: right length, finite, not all zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == dim)
    if not len(rows):
        return rows, np.zeros((0, dim), np.float32)
    flat = column.take(pa.array(rows)).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
    keep = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return rows[keep], x[keep]


def normalised(x: np.ndarray) -> np.ndarray:
    y = x.astype(np.float64)
    y /= np.abs(y).max(axis=1, keepdims=True)
    return (y / np.linalg.norm(y, axis=1, keepdims=True)).astype(np.float32)


def encode(r: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows x subvectors) and the norm of what they leave of the residuals ``r``."""
    m, _, d = codebooks.shape
    parts = r.reshape(len(r), m, d)
    codes = np.empty((len(r), m), np.uint8)
    left = np.zeros(len(r))
    for j in range(m):
        book = codebooks[j]
        codes[:, j] = np.argmax(parts[:, j] @ book.T - 0.5 * (book * book).sum(1), axis=1)
        left += ((parts[:, j] - book[codes[:, j]]) ** 2).sum(1)
    return codes, np.sqrt(left).astype(np.float32)


def fit(x: np.ndarray, lists: int, p: SimilarityParams) -> FieldModel:
    rng = np.random.default_rng(p.seed)
    x = normalised(x) if len(x) else np.eye(1, p.dim, dtype=np.float32)
    c = coarse(x, lists, p.iterations, rng)
    r = x - c[nearest(x, c)]
    d = p.dim // p.subvectors
    books = np.zeros((p.subvectors, 256, d), np.float32)
    for j in range(p.subvectors):
        part = np.ascontiguousarray(r[:, j * d : (j + 1) * d])
        b = kmeans(part[:: max(1, len(part) // 8192)], 256, p.iterations, rng, spherical=False)
        books[j, : len(b)] = b
        books[j, len(b) :] = b[0]
    return FieldModel(c, books)


def lay_out(models: list[FieldModel], sizes: list[np.ndarray], unit_rows: int) -> list[int]:
    """Give each list its units; neighbouring lists share one. Returns the first unit of each model, and the end."""
    units, starts = 0, []
    for model, size in zip(models, sizes):
        starts.append(units)
        model.first_unit, model.blocks = np.zeros(len(size), np.int64), np.ones(len(size), np.int64)
        rest = [np.arange(len(size))]
        while rest:
            part = rest.pop()
            if size[part].sum() <= unit_rows:
                model.first_unit[part] = units
                units += 1
            elif len(part) == 1:
                b = int(-(-size[part[0]] // unit_rows))
                model.first_unit[part], model.blocks[part] = units, b
                units += b * b
            else:
                c = model.centroids[part].astype(np.float64)
                c -= c.mean(axis=0)
                along = c @ np.linalg.svd(c, full_matrices=False)[2][0]
                order = part[np.argsort(along, kind="stable")]
                half = int(np.searchsorted(np.cumsum(size[order]), size[order].sum() / 2)) + 1
                half = min(max(half, 1), len(order) - 1)
                rest += [order[:half], order[half:]]
    return [*starts, units]


UNIT_SCHEMA = "unit int, h1 long, h2 int, home int, code binary, err float, asks binary, vec binary"


def fixed_binary(x: np.ndarray) -> pa.Array:
    """One binary value for each row of a two-dimensional array."""
    x = np.ascontiguousarray(x)
    width = x.shape[1] * x.itemsize
    offsets = np.arange(len(x) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(x.tobytes())])


def _payload(chunk: pa.Array) -> bytes:
    offsets = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
    return chunk.buffers()[2].slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes()


def lossless_halves(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (x.astype(np.float16).astype(np.float32) == x).all(axis=1)


def vectors_of(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Vectors sent as half precision where that loses nothing, else as float32."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1])
    out = np.empty((len(column), dim), np.float32)
    for dtype in (np.float16, np.float32):
        at = np.flatnonzero(lengths == dim * np.dtype(dtype).itemsize)
        if len(at):
            part = column.take(pa.array(at))
            out[at] = np.frombuffer(_payload(part), dtype).reshape(-1, dim)
    return out


def route(x: np.ndarray, h1: np.ndarray, h2: np.ndarray, asking: np.ndarray, model: FieldModel, p: SimilarityParams) -> Iterator[pa.RecordBatch]:
    """One row for each vector and unit that it belongs to or asks."""
    by = np.lexsort((~asking, h2, h1))  # of a class the asking row comes first
    fresh = np.ones(len(by), bool)
    fresh[1:] = (h1[by][1:] != h1[by][:-1]) | (h2[by][1:] != h2[by][:-1])
    keep = np.sort(by[fresh])
    x, h1, h2, asking = x[keep], h1[keep], h2[keep], asking[keep]
    y = normalised(x)
    near = y @ model.centroids.T
    n = p.probes(near.shape[1])
    probes = np.argpartition(-near, n - 1, axis=1)[:, :n] if n < near.shape[1] else np.tile(np.arange(n), (len(x), 1))
    probes = probes[asking]
    home = np.argmax(near, axis=1)
    codes, err = encode(y - model.centroids[home], model.codebooks)
    block = (mix64(h1.view(np.uint64)) >> np.uint64(1)).astype(np.int64)
    first, side = model.first_unit, model.blocks
    # as a member: its block, once for each block of queries
    times = side[home]
    row_m = np.repeat(np.arange(len(x)), times)
    step = np.arange(len(row_m)) - np.repeat(np.cumsum(times) - times, times)
    unit_m = first[home[row_m]] + step * side[home[row_m]] + block[row_m] % side[home[row_m]]
    # as a query: its block of queries, once for each block of members
    asker, lists = np.repeat(np.flatnonzero(asking), probes.shape[1]), probes.ravel()
    times = side[lists]
    row_q, list_q = np.repeat(asker, times), np.repeat(lists, times)
    step = np.arange(len(row_q)) - np.repeat(np.cumsum(times) - times, times)
    unit_q = first[list_q] + (block[row_q] % side[list_q]) * side[list_q] + step
    rows, units = np.concatenate([row_m, row_q]), np.concatenate([unit_m, unit_q])
    asked = np.concatenate([np.full(len(row_m), -1), list_q])
    order = np.lexsort((asked, rows, units))
    rows, units, asked = rows[order], units[order], asked[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (units[1:] != units[:-1])
    group = np.cumsum(new) - 1
    place = np.arange(len(rows)) - np.flatnonzero(new)[group]
    asks = np.full((int(new.sum()), int(place.max()) + 1 if len(place) else 1), -1, np.int32)
    asks[group, place] = asked
    rows, units = rows[new], units[new]
    member = asks[:, 0] < 0
    halves = lossless_halves(x)
    for dtype, part in ((np.float16, halves[rows]), (np.float32, ~halves[rows])):
        if part.any():
            r, m = rows[part], member[part]
            yield pa.RecordBatch.from_arrays(
                [pa.array(units[part].astype(np.int32)), pa.array(h1[r]), pa.array(h2[r]), pa.array(np.where(m, home[r], -1).astype(np.int32)), fixed_binary(codes[r] * m[:, None]), pa.array(np.where(m, err[r], 0).astype(np.float32)), fixed_binary(asks[part]), fixed_binary(x[r].astype(dtype))],
                names=["unit", "h1", "h2", "home", "code", "err", "asks", "vec"],
            )


PAIR_SCHEMA = "unit int, a1 long, a2 int, b1 long, b2 int, similarity double"
PAIR_ARROW = pa.schema([("unit", pa.int32()), ("a1", pa.int64()), ("a2", pa.int32()), ("b1", pa.int64()), ("b2", pa.int32()), ("similarity", pa.float64())])


def best_columns(score: np.ndarray, k: int) -> np.ndarray:
    return np.argpartition(-score, k - 1, axis=1)[:, :k] if k < score.shape[1] else np.tile(np.arange(score.shape[1]), (len(score), 1))


def scan_unit(table: pa.Table, starts: list[int], models: list[FieldModel], p: SimilarityParams) -> pa.Table:
    unit = table.column("unit")[0].as_py()
    model = models[int(np.searchsorted(starts, unit, side="right")) - 1]
    h1 = table.column("h1").to_numpy()
    h2 = table.column("h2").to_numpy()
    # several map batches may send the same class; one that asks goes before one that doesn't
    asks = table.column("asks").to_pylist()
    mute = np.maximum.reduceat(np.frombuffer(b"".join(asks), np.int32), np.cumsum([0] + [len(a) // 4 for a in asks[:-1]])) < 0
    by = np.lexsort((mute, h2, h1))
    fresh = np.ones(len(by), bool)
    fresh[1:] = (h1[by][1:] != h1[by][:-1]) | (h2[by][1:] != h2[by][:-1])
    table = table.take(pa.array(np.sort(by[fresh]))).combine_chunks()
    h1, h2, home = (table.column(c).to_numpy() for c in ("h1", "h2", "home"))
    v = vectors_of(table.column("vec"), p.dim)
    y = normalised(v)
    asks = table.column("asks").to_pylist()
    ask_row = np.repeat(np.arange(len(asks)), [len(a) // 4 for a in asks])
    ask_list = np.frombuffer(b"".join(asks), np.int32)
    ask_row, ask_list = ask_row[ask_list >= 0], ask_list[ask_list >= 0]
    err = table.column("err").to_numpy()
    codes = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(-1, p.subvectors)
    owned = np.flatnonzero(home >= 0)
    found_q, found_m, found_near = [], [], []
    d = p.dim // p.subvectors
    order = np.argsort(ask_list, kind="stable")
    for lst in np.unique(ask_list):
        lo, hi = np.searchsorted(ask_list[order], [lst, lst + 1])
        members = owned[home[owned] == lst]
        if not len(members):
            continue
        all_q = ask_row[order[lo:hi]]
        for at in range(0, len(all_q), 1024):
            q = all_q[at : at + 1024]
            yq = y[q]
            approx = np.repeat((yq @ model.centroids[lst])[:, None], len(members), axis=1)
            for j in range(p.subvectors):
                approx += np.take(yq[:, j * d : (j + 1) * d] @ model.codebooks[j].T, codes[members, j], axis=1)
            if p.min_similarity is not None:
                a, b = np.nonzero(approx + err[members][None, :] >= p.min_similarity - 1e-4)
            else:
                cols = best_columns(approx, p.refine * p.k + 1)
                a, b = np.repeat(np.arange(len(q)), cols.shape[1]), cols.ravel()
            keep = q[a] != members[b]
            found_q.append(q[a[keep]])
            found_m.append(members[b[keep]])
            found_near.append(approx[a[keep], b[keep]])
    if not found_q:
        return PAIR_ARROW.empty_table()
    q, m = np.concatenate(found_q), np.concatenate(found_m)
    if p.min_similarity is None:
        # of all lists of the unit together, the nearest by their codes go on
        order = np.lexsort((-np.concatenate(found_near), q))
        q, m = q[order], m[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < p.refine * p.k
        q, m = q[keep], m[keep]
    z = v.astype(np.float64)
    z /= np.linalg.norm(z / np.abs(z).max(axis=1, keepdims=True), axis=1, keepdims=True) * np.abs(z).max(axis=1, keepdims=True)
    sim = np.empty(len(q))
    for at in range(0, len(q), 65536):
        sim[at : at + 65536] = np.einsum("ij,ij->i", z[q[at : at + 65536]], z[m[at : at + 65536]])
    if p.min_similarity is not None:
        keep = sim >= p.min_similarity - 1e-9
        q, m, sim = q[keep], m[keep], sim[keep]
    order = np.lexsort((m, -sim, q))
    q, m, sim = q[order], m[order], sim[order]
    start = np.searchsorted(q, q)
    kth = start + p.k - 1
    last = np.minimum(kth, len(q) - 1)
    ties = (q[last] == q) & (kth < len(q))
    keep = (np.arange(len(q)) - start < p.k) | (ties & (sim >= sim[last]))
    q, m, sim = q[keep], m[keep], sim[keep]
    return pa.table({"unit": np.full(len(q), unit, np.int32), "a1": h1[q], "a2": h2[q], "b1": h1[m], "b2": h2[m], "similarity": sim}, schema=PAIR_ARROW)


class VectorIndex:
    """Centroids, codebooks and unit layout for one or more vector fields of a table."""

    def __init__(self, df: DataFrame, id_col: str, fields: list[str], params: SimilarityParams):
        ship_package(df.sparkSession)
        self.p, self.id_col, self.fields = params, id_col, fields
        # only what is needed, under names of our own
        self.df = df.where(F.col(id_col).isNotNull()).select(
            F.col(id_col).cast("string").alias("id"), *[F.col(f"`{f}`").cast("array<float>").alias(f"v{i}") for i, f in enumerate(fields)]
        )
        self._fit()

    def _fit(self) -> None:
        p, n = self.p, self.df.count()
        lists = int(np.clip(2 * np.sqrt(n), 1, min(p.max_lists, max(1, p.train_rows // 4))))
        wanted = min(p.train_rows, max(p.least_train, 4 * lists))
        share = min(1.0, wanted / max(n, 1))
        named = self.df.withColumn("h", F.xxhash64("id"))
        # by hash and value, so the sample doesn't depend on how rows are split over files
        picked = named.where(F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20) + 1)).orderBy("h", "id", *[f"v{i}" for i in range(len(self.fields))]).limit(wanted).toArrow()
        self.models = [fit(unit_vectors(picked.column(f"v{i}"), p.dim)[1], lists, p) for i in range(len(self.fields))]
        models = self.models

        def count(batches):
            # classes of copies count once for each batch; those that are a large part of a batch are remembered
            totals, often, seen = [np.zeros(len(m.centroids), np.int64) for m in models], {}, 0
            for batch in batches:
                seen += len(batch)
                for i, m in enumerate(models):
                    rows, x = unit_vectors(batch.column(f"v{i}"), p.dim)
                    if not len(x):
                        continue
                    h, first, times = np.unique(batch.column(f"h{i}_0").to_numpy()[rows], return_index=True, return_counts=True)
                    totals[i] += np.bincount(nearest(normalised(x[first]), m.centroids), minlength=len(m.centroids))
                    for k in np.flatnonzero(times >= max(2, len(batch) * p.hot_share / 16)):
                        often[i, int(h[k])] = often.get((i, int(h[k])), 0) + int(times[k])
            rows = [(i, t.astype("<i8").tobytes(), None, None) for i, t in enumerate(totals)] + [(i, None, h, c) for (i, h), c in often.items() if c >= seen * p.hot_share / 4]
            kinds = (pa.int32(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names=["f", "sizes", "h", "times"])

        sizes, copies = [np.zeros(len(m.centroids), np.int64) for m in models], {}
        hashed = self.df.select(*[f"v{i}" for i in range(len(self.fields))], *[self._hashes(i)[0].alias(f"h{i}_0") for i in range(len(self.fields))])
        for f, raw, h, times in hashed.mapInArrow(count, "f int, sizes binary, h long, times long").toLocalIterator():
            if raw is not None:
                sizes[f] += np.frombuffer(raw, "<i8")
            else:
                copies[f, h] = copies.get((f, h), 0) + times
        self.rows, self.list_sizes = n, sizes
        #: (field, hash) of classes that hold a large share of all rows; by the counts above fewer than 4 / hot_share a field
        self.hot = sorted(k for k, c in copies.items() if c >= max(n * p.hot_share / 2, 2 * p.k))
        self.starts = lay_out(models, sizes, p.unit_rows)

    def _hashes(self, i: int):
        v = F.col(f"v{i}")
        return F.xxhash64(v), F.hash(v)

    def class_pairs(self, queries=None) -> DataFrame:
        """(f, a1, a2, b1, b2, similarity): classes b near class a, before the cut to k."""
        p, models, starts, n = self.p, self.models, self.starts, len(self.fields)
        hashes = [h.alias(f"h{i}_{j}") for i in range(n) for j, h in enumerate(self._hashes(i))]
        asks = F.lit(True) if queries is None else queries
        src = self.df.select(asks.alias("asks"), *[f"v{i}" for i in range(n)], *hashes)

        def index(batches):
            for batch in batches:
                asking = batch.column("asks").to_numpy(zero_copy_only=False).astype(bool)
                for i, m in enumerate(models):
                    rows, x = unit_vectors(batch.column(f"v{i}"), p.dim)
                    step = rows_at_a_time(len(m.centroids))
                    for at in range(0, len(rows), step):
                        r = rows[at : at + step]
                        h1 = batch.column(f"h{i}_0").to_numpy()[r]
                        h2 = batch.column(f"h{i}_1").to_numpy()[r]
                        yield from route(x[at : at + step], h1, h2, asking[r], m, p)

        # a task holds few units at any size of the collection
        routed, tasks = src.mapInArrow(index, UNIT_SCHEMA), -(-starts[-1] // 4)
        if tasks > shuffle_partitions(self.df.sparkSession):
            routed = routed.repartition(tasks, "unit")
        pairs = routed.groupBy("unit").applyInArrow(lambda t: scan_unit(t, starts, models, p), PAIR_SCHEMA)
        number = sum((F.when(F.col("unit") >= at, 1).otherwise(0) for at in starts[1:-1]), F.lit(0))
        return pairs.select(number.cast("int").alias("f"), "a1", "a2", "b1", "b2", "similarity")

    def _is_hot(self, f: Column, h1: Column) -> Column:
        each = [F.when(f == i, h1.isin([h for g, h in self.hot if g == i])) for i in sorted({g for g, _ in self.hot})]
        return F.coalesce(*each, F.lit(False)) if each else F.lit(False)

    @property
    def salts(self) -> int:
        return max(8, shuffle_partitions(self.df.sparkSession))

    @property
    def class_key(self) -> list[str]:
        return ["f", "h1", "h2", "salt"] if self.hot else ["f", "h1", "h2"]

    def members(self) -> DataFrame:
        """(f, h1, h2, salt, id): the ids of each class; without hot classes there is no salt."""
        v = [F.col(f"v{i}") for i in range(len(self.fields))]
        top, low = [F.array_max(x) for x in v], [F.array_min(x) for x in v]
        valid = [(F.size(F.array_compact(x)) == self.p.dim) & (F.size(x) == self.p.dim) & ~F.isnan(a) & (F.abs(a) < float("inf")) & (F.abs(b) < float("inf")) & ((a != 0) | (b != 0)) for x, a, b in zip(v, top, low)]
        rows = [self.df.where(valid[i]).select(F.lit(i).alias("f"), *[h.alias(a) for h, a in zip(self._hashes(i), ("h1", "h2"))], "id") for i in range(len(self.fields))]
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        if self.hot:
            out = out.withColumn("salt", F.when(self._is_hot(F.col("f"), F.col("h1")), F.pmod(F.xxhash64("id"), F.lit(self.salts))).otherwise(0))
        # one exchange by class serves the removal of copies, the sizes and the joins; its tasks stay small
        parts = max(shuffle_partitions(self.df.sparkSession), -(-self.rows * len(self.fields) // 250_000))
        return out.repartition(parts, *self.class_key).distinct()

    def neighbours(self, queries=None, symmetric: bool | None = None) -> DataFrame:
        """(field, id, neighbour, similarity, rank), the k most similar of each queried class.

        symmetric: a pair that either side found counts for both (every row
        asks). Vectors that are null, of another length, not finite or all
        zero take no part. Equally similar ids are taken in their order, among
        the k nearest classes of copies; equally near classes fall to the smaller hash.
        """
        p = self.p
        found = self.class_pairs(queries)
        if symmetric if symmetric is not None else queries is None:
            turned = [F.struct(*[F.col(c).alias(n) for c, n in zip(names, ("a1", "a2", "b1", "b2"))]) for names in (("a1", "a2", "b1", "b2"), ("b1", "b2", "a1", "a2"))]
            found = found.select("f", F.explode(F.array(*turned)).alias("s"), "similarity").select("f", "s.*", "similarity")
        # units may find a pair twice, with another last bit
        found = found.groupBy("f", "a1", "a2", "b1", "b2").agg(F.max("similarity").alias("similarity"))
        w = Window.partitionBy("f", "a1", "a2").orderBy(F.desc("similarity"), "b1", "b2")
        top = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= p.k)
        member = self.members()
        # no id needs more of a class than its k smallest ids besides itself, nor more than k others of all classes
        key, by_id = ["f", "h1", "h2"], Window.partitionBy(*self.class_key).orderBy("id")
        few = member.withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= p.k + 1).groupBy(*self.class_key).agg(F.sort_array(F.collect_list("id")).alias("ids"))
        if self.hot:
            few = few.groupBy(*key).agg(F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, p.k + 1).alias("ids"))
        near = top.join(few.select("f", F.col("h1").alias("b1"), F.col("h2").alias("b2"), "ids"), ["f", "b1", "b2"]).select("f", F.col("a1").alias("h1"), F.col("a2").alias("h2"), "similarity", F.slice("ids", 1, p.k).alias("ids"))
        own = few.where(F.size("ids") > 1).select(*key, F.lit(1.0).alias("similarity"), "ids")
        entries = F.transform("ids", lambda i: F.struct((-F.col("similarity")).alias("far"), i.alias("neighbour")))
        best = near.unionByName(own).groupBy(*key).agg(F.slice(F.array_sort(F.flatten(F.collect_list(entries))), 1, p.k + 1).alias("best"))
        if self.hot:
            every_salt = F.sequence(F.lit(0).cast("long"), F.lit(self.salts - 1).cast("long"))
            best = best.withColumn("salt", F.explode(F.when(self._is_hot(F.col("f"), F.col("h1")), every_salt).otherwise(F.array(F.lit(0).cast("long")))))
        asking = member if queries is None else member.where(queries)
        others = F.slice(F.filter("best", lambda x: x["neighbour"] != F.col("id")), 1, p.k)
        every = asking.join(best, self.class_key).select("f", "id", F.posexplode(others).alias("at", "x"))
        every = every.select("f", "id", F.col("x.neighbour").alias("neighbour"), (-F.col("x.far")).alias("similarity"), (F.col("at") + 1).alias("rank"))
        names = F.element_at(F.array(*[F.lit(f) for f in self.fields]), F.col("f") + 1)
        return every.select(names.alias("field"), "id", "neighbour", "similarity", "rank")


def similar_vectors(df: DataFrame, id_col: str, fields: list[str], params: SimilarityParams | None = None, queries=None) -> DataFrame:
    """The most similar vectors of each vector field; see :meth:`VectorIndex.neighbours`.

    queries: a boolean Column over the string column ``id``; None asks for
    every row. An empty table gives no rows; null ids take no part; a row that
    stands twice counts once.
    """
    return VectorIndex(df, id_col, fields, params or SimilarityParams()).neighbours(queries)


FIELDS = ["embedding", "signature_embedding"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks with a cosine of 0.9 or more, one among the other's ten most similar."""
    near = similar_vectors(read(spark, sf_dir, "code_embeddings"), "chunk_id", FIELDS, SimilarityParams(min_similarity=0.9, nprobe=3))
    return near.select(F.col("field").alias("vector_field"), F.least("id", "neighbour").alias("chunk_id_a"), F.greatest("id", "neighbour").alias("chunk_id_b")).distinct()


def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar vectors, without a threshold, for the ids divisible by 100, over all rows."""
    by_100 = F.pmod(F.conv(F.substring("id", -12, 12), 16, 10).cast("long"), F.lit(100)) == 0
    return similar_vectors(read(spark, sf_dir, "code_embeddings"), "chunk_id", FIELDS, SimilarityParams(nprobe=0.25, refine=8), queries=by_100).withColumn("similarity", F.round("similarity", 6))


#: brute force, for small tables
P1_SQL = r"""
with v as (select distinct 'embedding' as f, chunk_id, embedding::double[] as x from code_embeddings union select distinct 'signature_embedding', chunk_id, signature_embedding::double[] from code_embeddings),
ok as (select f, chunk_id, x from v where x is not null and len(x) = 64 and len(list_filter(x, lambda e: e is null or isnan(e) or isinf(e))) = 0 and len(list_filter(x, lambda e: e <> 0)) > 0),
p as (select a.f, a.chunk_id as i, b.chunk_id as j, list_cosine_similarity(a.x, b.x) as s from ok a join ok b on a.f = b.f and a.chunk_id <> b.chunk_id where list_cosine_similarity(a.x, b.x) >= 0.9),
k as (select *, row_number() over (partition by f, i order by s desc, j) as r from p)
select distinct f as vector_field, least(i, j) as chunk_id_a, greatest(i, j) as chunk_id_b from k where r <= 10
"""

QUERIES = {"p1_found": p1_found, "p1_neighbours": p1_neighbours}
ORACLES = {"p1_found": P1_SQL}
