import random
import re
from collections import defaultdict

import numpy as np

from lodestrata.llm.hostruns import PAGES, RunParams, page_blocks, unique_runs, windows


def frame(spark, rows):
    return spark.createDataFrame([(h, i, ["paragraph"] * len(t), t) for h, i, t in rows], PAGES)


def kept_tokens(found):
    out = defaultdict(list)
    for r in sorted(found, key=lambda r: (r.id, r.position)):
        out[r.id] += re.findall(r"[^\W_]+", r.text.lower())
    return dict(out)


def brute(rows, p):
    """Tokens that no window on enough pages of the host covers."""
    pages = {(h, i): [w.lower() for t in texts for w in re.findall(r"[^\W_]+", t)] for h, i, texts in rows}
    on = defaultdict(set)
    for (h, i), words in pages.items():
        for k in range(len(words) - p.least_tokens + 1):
            on[h, tuple(words[k : k + p.least_tokens])].add(i)
    out = {}
    for (h, i), words in pages.items():
        gone = set()
        for k in range(len(words) - p.least_tokens + 1):
            if len(on[h, tuple(words[k : k + p.least_tokens])]) >= p.least_pages:
                gone |= set(range(k, k + p.least_tokens))
        left = [w for k, w in enumerate(words) if k not in gone]
        if left:
            out[i] = left
    return out


def pages(n=40, seed=3):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    shared = [" ".join(rng.choice(words) for _ in range(rng.randint(6, 25))) for _ in range(6)]
    rows = []
    for k in range(n):
        blocks = []
        for _ in range(rng.randint(1, 6)):
            blocks.append(rng.choice(shared) if rng.random() < 0.4 else " ".join(rng.choice(words) for _ in range(rng.randint(3, 30))))
        rows.append((f"h{k % 3}", f"p{k:02d}", blocks))
    return rows


def test_order_is_that_of_the_suffixes():
    code = np.array([random.Random(1).randrange(3) for _ in range(200)])
    order, rank = windows(code, 7)
    prefix = [tuple(code[i : i + 7]) for i in range(200)]
    assert [prefix[i] for i in order] == sorted(prefix)
    assert all((rank[i] == rank[j]) == (prefix[i] == prefix[j]) for i in range(0, 200, 7) for j in range(200))


def test_same_as_brute_force_in_one_shard_and_in_many(spark):
    rows = pages()
    for least_tokens, least_pages in ((5, 2), (8, 3)):
        p = RunParams(least_tokens=least_tokens, least_pages=least_pages)
        want = brute(rows, p)
        assert sum(map(len, want.values())) < 0.9 * sum(len(re.findall(r"\w+", t)) for _, _, ts in rows for t in ts)
        for q in (p, RunParams(least_tokens=least_tokens, least_pages=least_pages, shard_chars=500), RunParams(least_tokens=least_tokens, least_pages=least_pages, shard_chars=500, max_fragments=2)):
            assert kept_tokens(unique_runs(frame(spark, rows), q).collect()) == want


def test_without_the_arrays_boilerplate_stays(spark):
    footer = "Released under the same terms as every other part of this project, see the file LICENSE for all of them."
    rows = [("h", f"p{k}", [f"Something of its own says page number{k}.", footer]) for k in range(4)] + [("other", "q", ["Alone here.", footer])]
    found = {(r.id, r.position): r.text for r in unique_runs(frame(spark, rows)).collect()}
    assert found == {**{(f"p{k}", 0): f"Something of its own says page number{k}." for k in range(4)}, ("q", 0): "Alone here.", ("q", 1): footer}
    never = {(r.id, r.position) for r in unique_runs(frame(spark, rows), RunParams(least_pages=99)).collect()}
    assert never == {(i, n) for _, i, ts in rows for n in range(len(ts))}


def test_parts_of_blocks_stay_and_blocks_without_tokens_too(spark):
    run = " ".join(f"r{k}" for k in range(15))
    rows = [("h", f"p{k}", [f"Words own{k}, {run}; other{k} then.", "—", ""]) for k in range(3)]
    found = {(r.id, r.position): r.text for r in unique_runs(frame(spark, rows)).collect()}
    assert found["p1", 0] == "Words own1, other1 then." and found["p1", 1] == "—"


def test_nulls_repeated_rows_long_texts_and_empty_tables(spark):
    schema = "chunk_id string, project_name string, file_path string, content string, kinds string, host int"
    rows = [("a", None, "README.md", "# Title\n\nWords.", "x", 1), ("a", None, "README.md", "# Title\n\nWords.", "x", 1), (None, "p", "README.md", "Words.", "x", 1), ("n", "p", None, None, "x", 1), ("e", "p", "R.md", "", "x", 1), ("l", "p", "R.md", "word " * 60000, "x", 1)]
    df = spark.createDataFrame(rows, schema)
    read = lambda d: unique_runs(page_blocks(d, "chunk_id", "project_name", "file_path", "content"))
    found = [(r.id, r.kind, len(r.text)) for r in read(df).collect()]
    assert sorted(found) == [("a", "heading", 5), ("a", "paragraph", 6), ("l", "paragraph", 299999)]
    assert read(df.limit(0)).count() == 0
