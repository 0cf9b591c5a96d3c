import random
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

from lodestrata.llm.spam import F_AT, FEATURES, SpamParams, bag, features_of, grow, measured, scores, signs_of, spam_scores, weak_labels

SCHEMA = "id long, text string, host string, score double, spam boolean"


def texts(seed=1, goods=60, bads=60):
    rng = random.Random(seed)
    words = ["index", "vector", "chunk", "query", "table", "graph", "token", "shard"]
    w = lambda: rng.choice(words)
    good, bad = [], []
    said = ["The {} is not a {}, even if both look {} when it grows.", "Why does the {} of a {} wait for its {}?", "We moved every {} into the {} because the {} was late.", "You can read a {} twice, but each {} keeps its own {}."]
    for _ in range(goods):
        good.append(" ".join(rng.choice(said).format(w(), w(), w() + str(rng.randint(1, 99))) for _ in range(rng.randint(3, 19))))
    for _ in range(bads):
        k = f"{w()} {w()}x"
        bad.append(rng.choice([" | ".join([k] * 40), "\n".join(f"http://{w()}{i}.example/{w()}" for i in range(40)), " ".join(f"#{w()}{w()}" for _ in range(50)), " ".join(f"Get {k} now, {k} today, {k} for {w()}!" for _ in range(20))]))
    return good, bad


def signs(ts):
    return np.array([signs_of(t) for t in ts])


def test_features_of_known_texts():
    x = features_of(["alpha beta. Alpha beta! alpha beta", None, "", " \n", "see https://a.example/b and www.c.test", "#one #two three", "| a | b |\n| c | d |", "2025-01-01 x\n--flag y"])
    f = lambda i, name: round(float(x[i, F_AT[name]]), 3)
    assert f(0, "unique") == 0.333 and f(0, "pair") == 1.0 and f(0, "shouts") == 0.167 and not x[1:4].any()
    assert f(4, "link_chars") > 0.6 and f(4, "stops") == 0.5 and f(5, "hashtags") > 0.5 and f(6, "tables") == 1.0 and (f(7, "logged"), f(7, "help")) == (0.5, 0.5)


def test_labels_speak_for_clear_cases_only():
    good, bad = texts()
    labels = weak_labels(signs(good + bad))
    assert not (labels[:60] == 1).any() and not (labels[60:] == 0).any()
    assert 0.1 < (labels >= 0).mean() < 0.9
    log = "\n".join(f"2025-01-01T00:0{i % 10} INFO a::b took {i} ms" for i in range(40))
    table = "| name | rows |\n|---|---|\n" + "\n".join(f"| shard_{i} | {i} |" for i in range(30))
    assert weak_labels(signs([log, table])).tolist() == [0, 0]


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="test tables are not here")
def test_trees_decide_what_the_labels_leave_open():
    given = [t or "" for t in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column("text").to_pylist()]
    p = SpamParams()
    x, labels = measured(given, p), weak_labels(signs(given))
    found = scores(x, bag(x[labels >= 0], labels[labels >= 0], p)) > p.threshold
    open_ = labels < 0
    assert open_.mean() > 0.4
    only_trees = np.flatnonzero(open_ & found)  # pages that nobody would find without the trees
    assert len(only_trees) >= 20
    assert all(max(x[i, F_AT[f]] for f in ("pair", "pairs", "link_chars", "hashtags", "starts")) > 0.2 for i in only_trees)


def test_trees_learn_held_out_rows():
    good, bad = texts(2)
    x = features_of(good + bad)
    y = np.array([0] * 60 + [1] * 60)
    rows = np.random.default_rng(0).permutation(120)
    trees = bag(x[rows[:80]], y[rows[:80]], SpamParams(trees=9))
    assert ((scores(x[rows[80:]], trees) > 0.5) == y[rows[80:]]).mean() >= 0.95
    assert bag(x[:60], y[:60], SpamParams()) == [] and scores(x, []).tolist() == [0.0] * 120
    one = grow(np.zeros((10, len(FEATURES))), np.array([0.0, 1.0] * 5), SpamParams(), np.random.default_rng(0))
    assert one.predict(np.zeros((2, len(FEATURES)))).tolist() == [0.5, 0.5]


def test_slices_and_long_texts_give_the_same_features():
    good, bad = texts(4)
    some = [*good[:20], None, "", *bad[:20], "word other " * 30000]
    assert np.array_equal(measured(some, SpamParams()), measured(some, SpamParams(slice_chars=500)))


def test_hosts_move_scores(spark):
    good, bad = texts(5)
    rows = [(i, t, f"good{i % 3}", 1.0, True) for i, t in enumerate(good)] + [(100 + i, t, f"bad{i % 2}", 1.0, True) for i, t in enumerate(bad)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {pull: {r.id: r.score for r in spam_scores(df, "id", "text", "host", SpamParams(host_pull=pull, host_rows=5.0)).collect()} for pull in (0.0, 2.0)}
    assert all(got[2.0][i] > got[0.0][i] for i in got[0.0] if i >= 100 and 0 < got[0.0][i] < 0.99)
    assert all(got[2.0][i] < got[0.0][i] for i in got[0.0] if i < 100 and 0.01 < got[0.0][i] < 1)


def test_rows_split_otherwise_give_the_same_scores(spark):
    good, bad = texts(6)
    df = spark.createDataFrame([(i, t, "h", 0.0, True) for i, t in enumerate(good + bad)], SCHEMA)
    p = SpamParams(train_rows=80)
    one, many = ({r.id: round(r.score, 9) for r in spam_scores(d, "id", "text", "host", p).collect()} for d in (df.coalesce(1), df.repartition(7, "text")))
    assert one == many


def test_table(spark):
    good, bad = texts(3, 300, 40)
    rows = [(i, t, "h" if i % 3 else None, 1.0, True) for i, t in enumerate(good + bad)] + [(900, None, "h", 0.0, True), (901, "", "h", 0.0, True), (902, " \n", None, 0.0, True), (903, "word " * 50000, "h", 0.0, True), (0, good[0], "h", 0.0, True)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = spam_scores(df, "id", "text", "host").collect()
    assert len(got) == len(rows)
    spam = {r.id for r in got if r.spam}
    assert spam <= {*range(300, 340), 903} and len(spam) >= 38
    assert all(r.score == 0 for r in got if r.id in (900, 901, 902))
    assert spam_scores(df.limit(0), "id", "text", "host").count() == 0
