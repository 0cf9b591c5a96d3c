from itertools import product

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm.packing import PackingParams, best_fit_decreasing, bounds, lower_bound, pack


def fewest(sizes, cap):
    for n in range(len(sizes) + 1):
        for where in product(range(max(n, 1)), repeat=len(sizes)):
            if n and all(sum(s for s, w in zip(sizes, where) if w == b) <= cap for b in range(n)) or not sizes:
                return n
    return 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 10), max_size=5))
def test_bound_never_exceeds_the_optimum(sizes):
    assert lower_bound(np.array(sizes, np.int64), 10) <= fewest(sizes, 10)


@given(st.lists(st.integers(0, 50), max_size=200))
def test_best_fit_fills_no_bin_beyond_its_capacity(sizes):
    bins, used = best_fit_decreasing(np.array(sizes, np.int64), 50)
    load = np.bincount(bins, weights=sizes, minlength=used) if sizes else np.zeros(0)
    assert (load <= 50).all() and lower_bound(np.array(sizes, np.int64), 50) <= max(used, 0)


def test_bound_beats_the_volume():
    assert lower_bound(np.array([6, 6, 6]), 10) == 3


def run(spark, rows, caps=((1, 10), (2, 64)), **k):
    items = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    return items, spark.createDataFrame(list(caps), "pack_id int, capacity int"), PackingParams(**k)


def test_every_item_once_split_only_beyond_capacity(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(n)) for i, n in enumerate(rng.integers(0, 40, 400))] + [(900, 205), (901, None), (902, 10), (5, 3), (None, 4)]
    items, caps, p = run(spark, rows, shard_items=50, rounds=2)
    got = pack(items, caps, p).toPandas()
    want = {}
    for i, n in rows:
        if i is not None:
            want[i] = max(want.get(i, 0), n or 0)
    for pack_id, cap in ((1, 10), (2, 64)):
        g = got[got.pack_id == pack_id]
        assert (g.groupby("container_id").n_tokens.sum() <= cap).all()
        assert g.groupby("doc_id").n_tokens.sum().to_dict() == want
        pieces = g.groupby("doc_id").size()
        assert all(pieces[i] == max(1, -(-n // cap)) for i, n in want.items())
        assert not g.duplicated(["doc_id", "piece"]).any()
        least = lower_bound(np.concatenate([[min(cap, n - k) for k in range(0, n, cap)] for n in want.values() if n]), cap)
        assert g[g.n_tokens > 0].container_id.nunique() <= 1.05 * least + 2


def test_bounds_and_empty_tables(spark):
    items, caps, p = run(spark, [(1, 6), (2, 6), (3, 4)], caps=[(1, 10)])
    row = bounds(items, caps, pack(items, caps, p)).first()
    assert (row.containers, row.lower_bound) == (2, 2)
    assert pack(items.limit(0), caps, p).count() == 0
    assert pack(items, caps.limit(0), p).count() == 0
