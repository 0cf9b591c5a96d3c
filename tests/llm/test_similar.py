import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestrata.llm.similar import SimilarityParams, VectorIndex, coarse, fit, lay_out, nearest, normalised, route, scan_unit, similar_vectors

SCHEMA = "id string, v array<float>, `rank` int, field string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)


def brute(ids, x, k, least):
    x = x.astype(np.float64)
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = y @ y.T
    np.fill_diagonal(s, -2)
    return {(ids[a], ids[b]) for a in range(len(ids)) for b in np.argsort(-s[a], kind="stable")[:k] if s[a, b] >= least}


def data(n=600, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 3, 64))
    x = np.concatenate([base, base + 0.15 * rng.normal(size=base.shape), rng.normal(size=(n - 2 * len(base), 64))]).astype(np.float32)
    return [f"i{j:04d}" for j in range(len(x))], x


def test_range_search_finds_the_same_as_brute_force(spark):
    ids, x = data()
    p = SimilarityParams(min_similarity=0.9, nprobe=4, unit_rows=64)
    got = {(r.id, r.neighbour) for r in similar_vectors(frame(spark, zip(ids, x.tolist())), "id", ["v"], p).collect()}
    want = brute(ids, x, 10, 0.9)
    assert got <= want and len(got & want) >= 0.97 * len(want)


def test_knn_recall_and_query_subset(spark):
    ids, x = data()
    found = similar_vectors(frame(spark, zip(ids, x.tolist())), "id", ["v"], SimilarityParams(nprobe=0.7, refine=8), queries=F.col("id").endswith("00")).collect()
    want = {(a, b) for a, b in brute(ids, x, 10, -1) if a.endswith("00")}
    got = {(r.id, r.neighbour) for r in found}
    assert {r.id for r in found} == {i for i in ids if i.endswith("00")}
    assert len(got & want) >= 0.9 * len(want)


def test_hot_list_is_spread_over_a_grid(spark):
    rng = np.random.default_rng(3)
    x = (np.ones(64) + 0.02 * rng.normal(size=(300, 64))).astype(np.float32)
    ids = [f"h{j}" for j in range(300)]
    p = SimilarityParams(min_similarity=0.9, nprobe=1, unit_rows=50, max_lists=1)
    got = {(r.id, r.neighbour) for r in similar_vectors(frame(spark, zip(ids, x.tolist())), "id", ["v"], p).collect()}
    assert got == brute(ids, x, 10, 0.9)


def test_invalid_vectors_copies_and_repeated_rows(spark):
    e = [0.0] * 64
    a, b = e.copy(), e.copy()
    a[0], b[1] = 1.0, 1.0
    nan = a.copy()
    nan[5] = float("nan")
    hole = [*a[:-1], None]
    rows = [("a", a), ("a", a), ("c", a), ("s", [2 * v for v in a]), ("b", b), ("z", e), ("n", nan), ("w", a[:32]), ("0", []), ("u", None), ("h", hole), (None, a)]
    found = similar_vectors(frame(spark, rows), "id", ["v"], SimilarityParams(min_similarity=0.9)).collect()
    assert {(r.id, r.neighbour) for r in found} == {("a", "c"), ("c", "a"), ("a", "s"), ("s", "a"), ("c", "s"), ("s", "c")}
    assert all(abs(r.similarity - 1) < 1e-9 for r in found)


def test_copies_have_the_same_neighbours_at_every_class_size(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=64)
    b, c = a + 0.1 * rng.normal(size=64), rng.normal(size=64)
    sizes = {"a": 70, "b": 9, "c": 1, "d": 4200, "e": 1}
    vectors = dict(zip("abcde", (a, b, c, -a, -b)))
    ids = [f"{name}{j:04d}" for name, n in sizes.items() for j in range(n)]
    of = {name: v.astype(np.float32).tolist() for name, v in vectors.items()}
    want = set()
    for i in ids:
        own, other = ([j for j in ids if j[0] == n and j != i][:10] for n in (i[0], {"a": "b", "b": "a", "d": "e", "e": "d"}.get(i[0], "-")))
        want |= {(i, j, r) for r, j in enumerate([*own, *other][:10], 1)}
    p = SimilarityParams(min_similarity=0.9, nprobe=1.0)
    found = similar_vectors(frame(spark, [(i, of[i[0]]) for i in ids]), "id", ["v"], p)
    rows = found.collect()
    assert len(rows) == len(want) and {(r.id, r.neighbour, r.rank) for r in rows} == want
    asked = similar_vectors(frame(spark, [(i, of[i[0]]) for i in ids]), "id", ["v"], p, queries=F.col("id").isin("a0069", "b0008", "e0000")).collect()
    assert {(r.id, r.neighbour, r.rank) for r in asked} == {x for x in want if x[0] in ("a0069", "b0008", "e0000")}


def test_a_copy_that_asks_goes_before_a_mute_one_of_another_batch():
    _, x = data(120)
    p = SimilarityParams(nprobe=2)
    model = fit(x, 4, p)
    starts = lay_out([model], [np.array([30] * 4)], p.unit_rows)
    h = np.arange(len(x), dtype=np.int64)
    # the first batch has id 0 mute beside rows that ask two lists of the unit; the second has its copy, asking
    first = route(x, h, h.astype(np.int32), h % 2 == 1, model, p)
    second = route(x[:1], h[:1], h[:1].astype(np.int32), np.array([True]), model, p)
    found = scan_unit(pa.Table.from_batches([*first, *second]), starts, [model], p).to_pydict()
    assert set(found["a1"]) == {0, *range(1, len(x), 2)}


def test_a_class_with_a_third_of_all_rows_is_salted_and_loses_nothing(spark):
    rng = np.random.default_rng(8)
    hot, near = rng.normal(size=64), rng.normal(size=(60, 64))
    close = hot + 0.1 * rng.normal(size=64)
    rows = [(f"h{j:03d}", hot.astype(np.float32).tolist()) for j in range(50)] + [(f"n{j:03d}", v.astype(np.float32).tolist()) for j, v in enumerate(near)] + [("x", close.astype(np.float32).tolist())]
    p = SimilarityParams(min_similarity=0.9, nprobe=1.0)
    index = VectorIndex(frame(spark, rows), "id", ["v"], p)
    assert len(index.hot) == 1 and index.class_key[-1] == "salt"
    got = {(r.id, r.neighbour, r.rank) for r in index.neighbours().collect()}
    copies = [f"h{j:03d}" for j in range(50)]
    want = {(i, j, r) for i in copies for r, j in enumerate([c for c in copies if c != i][:10], 1)} | {("x", j, r) for r, j in enumerate(copies[:10], 1)}
    assert got == want
    assert sum(m.sum() for m in index.list_sizes) <= 62 + 4 * 2  # copies don't make a list large


def test_samples_and_lists_do_not_depend_on_file_splits(spark):
    ids, x = data()
    df = frame(spark, zip(ids, x.tolist()))
    p = SimilarityParams(least_train=100, train_rows=100)
    one, many = (VectorIndex(d, "id", ["v"], p).models[0].centroids for d in (df.coalesce(1), df.repartition(5, "rank", "id")))
    assert np.array_equal(one, many)


def test_two_levels_of_centroids_cover_the_sphere():
    rng = np.random.default_rng(2)
    x = normalised(rng.normal(size=(4000, 64)).astype(np.float32))
    flat, deep = coarse(x, 200, 5, np.random.default_rng(1)), coarse(x, 200, 5, np.random.default_rng(1), flat=50)
    assert 180 <= len(deep) <= 220
    fits = [float((x * c[nearest(x, c)]).sum(1).mean()) for c in (flat, deep)]
    assert fits[1] > 0.93 * fits[0]


def test_empty_table(spark):
    assert similar_vectors(frame(spark, []), "id", ["v"], SimilarityParams(min_similarity=0.9)).count() == 0
