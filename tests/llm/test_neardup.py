import random
from collections import Counter

import pyarrow as pa
import pyarrow.compute  # noqa: F401

from lodestrata.llm.neardup import NearDupParams, answer_fragment, id_cell, judge_block, pack_block, near_duplicate_groups, near_duplicates

SCHEMA = "id string, text string, a string, grams int, n int"
P = NearDupParams(words=3, threshold=0.7, min_tokens=20)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)


def pairs(spark, rows, p=P):
    return {(r.a, r.b) for r in near_duplicates(frame(spark, rows), "id", "text", p).pairs().collect()}


def brute(rows, p=P):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        if i is not None and len(w) >= p.min_tokens:
            sets[i] = {tuple(w[k : k + p.words]) for k in range(len(w) - p.words + 1)}
    ids = sorted(sets)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) >= p.threshold * len(sets[a] | sets[b]) - 1e-12}


def collection(n=120, seed=5):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(15, 60))]
        rows.append((f"d{k:03d}", " ".join(text)))
        for v in range(rng.randint(0, 3)):
            other = text.copy()
            for _ in range(rng.randint(0, 5)):
                other[rng.randrange(len(other))] = rng.choice(words)
            rows.append((f"d{k:03d}v{v}", " ".join(other)))
    return rows


def test_same_pairs_as_brute_force(spark):
    rows = collection()
    want = brute(rows)
    assert len(want) > 40
    assert pairs(spark, rows) == want


def test_hot_ngrams_in_blocks_give_the_same_pairs(spark):
    rng = random.Random(2)
    base = [f"b{k}" for k in range(40)]
    rows = []
    for k in range(60):
        text = base.copy()
        text[rng.randrange(40)] = f"x{k}"
        rows.append((f"h{k:02d}", " ".join(text)))
    small = NearDupParams(words=3, threshold=0.7, min_tokens=20, hot=7, block_records=16)
    assert pairs(spark, rows, small) == brute(rows) == pairs(spark, rows)


def test_other_lengths_and_thresholds(spark):
    rows = collection(60, 9)
    p = NearDupParams(words=5, threshold=0.8, min_tokens=5)
    assert pairs(spark, rows, p) == brute(rows, p)


def test_copies_repeated_rows_nulls_and_short_texts(spark):
    text = " ".join(f"t{k}" for k in range(30))
    rows = [("a", text), ("a", text), ("b", text.upper()), ("s", "too short"), ("s2", "too short"), ("n", None), ("e", ""), (None, text), ("l", text + " " + " ".join(f"m{k}" for k in range(30000)))]
    assert pairs(spark, rows) == {("a", "b")}


def test_many_copies_form_a_star(spark):
    text = " ".join(f"t{k}" for k in range(30))
    rows = [(f"c{k:03d}", text) for k in range(90)] + [("near", text + " end")]
    p = NearDupParams(words=3, threshold=0.7, min_tokens=20, expand=64)
    assert pairs(spark, rows, p) == {("c000", f"c{k:03d}") for k in range(1, 90)} | {("c000", "near")}


def test_large_classes_of_equal_sets_come_out_as_all_pairs(spark):
    text = " ".join(f"t{k}" for k in range(30))
    rows = [(f"c{k:03d}", text if k % 2 else text.upper()) for k in range(90)] + [(f"n{k:03d}", text + " end") for k in range(50)]
    want = brute(rows)
    assert len(want) == 140 * 139 // 2
    found = near_duplicates(frame(spark, rows), "id", "text", P).pairs().collect()
    assert len(found) == len(want) and {(r.a, r.b) for r in found} == want


def test_groups_are_components(spark):
    rows = collection(60, 4)
    text = " ".join(f"t{k}" for k in range(30))
    rows += [(f"z{k}", text) for k in range(5)]
    want = brute(rows)
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in want:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    linked = {x for p in want for x in p}
    got = {r.id: (r.group_id, r.links) for r in near_duplicate_groups(near_duplicates(frame(spark, rows), "id", "text", P)).collect()}
    assert got == {x: (find(x), sum(x in p for p in want)) for x in linked}


def test_ids_of_blocks_are_spread_over_cells():
    for fragments in (16, 64, 128, 400, 1024):
        cells = Counter(id_cell(task << 24 | seq, fragments) for task in range(1000) for seq in range(2))
        assert len(cells) >= 0.8 * min(fragments, 2000) and max(cells.values()) <= 6 + 2 * 2000 // fragments
        assert min(cells) >= fragments and max(cells) < 2 * fragments


def test_records_with_very_many_shared_ngrams_are_counted_in_full():
    text = " ".join(f"t{k}" for k in range(90_000))
    p = NearDupParams(words=3, threshold=0.7, min_tokens=20)
    blobs = pa.Table.from_batches([pack_block(b, [f"d{b}"], [text + f" x{b}"], 1, p) for b in (0, 1)])
    cell = lambda t, at: t.filter(pa.compute.equal(t.column("cell"), at))
    answers = answer_fragment(cell(blobs, 0), 1)
    both = pa.concat_tables([answers, cell(blobs, 1)])
    kept = [judge_block(both.filter(pa.compute.equal(both.column("block"), b)), p).column("id").to_pylist() for b in (0, 1)]
    assert kept == [["d0"], ["d1"]]


def test_empty_table(spark):
    assert pairs(spark, []) == set()
