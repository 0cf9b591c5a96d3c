import math

from hypothesis import given
from hypothesis import strategies as st

from lodestrata.llm.distinctive import distinctive_terms, most_distinctive, p2_found, tokens_of

SCHEMA = "id string, text string, term string, z double"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 0.0) for i, t in rows], SCHEMA)


def test_scores_follow_the_formula_and_hot_terms_score_alike(spark):
    rows = [("a", "alpha alpha alpha beta gamma"), ("b", "beta beta gamma delta"), ("c", "beta gamma gamma")]
    for hot in (0, 2, 100):
        got = {(r.id, r.term): r for r in distinctive_terms(frame(spark, rows), "id", "text", prior_tokens=10, hot_terms=hot).collect()}
        assert len(got) == 8
        n = 12
        r = got["b", "beta"]
        assert (r.tf, r.cf, r.df) == (2, 4, 3)
        a = 4 * 10 / n
        here, rest = 2 + a, 2 + a
        z = (math.log(here / (4 + 10 - here)) - math.log(rest / (n - 4 + 10 - rest))) / math.sqrt(1 / here + 1 / rest)
        assert abs(r.z - z) < 1e-9
        assert got["b", "beta"].z > got["a", "beta"].z


def test_bounds_nulls_and_repeated_rows(spark):
    rows = [("a", "word word word Ünï_x 9abc"), ("a", "word word word Ünï_x 9abc"), ("b", "word"), ("n", None), ("e", ""), (None, "word word word"), ("l", "long " * 20000)]
    got = {(r.id, r.term): (r.tf, r.cf, r.df) for r in distinctive_terms(frame(spark, rows), "id", "text", min_tf=3, min_df=1, max_df=8, min_length=4).collect()}
    assert got == {("a", "word"): (3, 4, 2), ("l", "long"): (20000, 20000, 1)}


def test_frequency_alone_chooses_rows(spark, tmp_path):
    rows = [("long", "alpha alpha alpha " + "filler " * 20000), ("short", "alpha " * 17 + "beta beta beta"), ("other", "gamma")]
    spark.createDataFrame(rows, "chunk_id string, code_content string").write.parquet(f"{tmp_path}/code_chunks.parquet")
    assert {tuple(r) for r in p2_found(spark, str(tmp_path)).collect()} == {("long", "alpha"), ("short", "alpha")}


def test_z_ranks_terms_where_counts_would_not(spark):
    rows = [(f"d{k}", "common " * 9 + f"rare{k % 3} " * 4 + "filler " * k) for k in range(9)]
    scored = distinctive_terms(frame(spark, rows), "id", "text", min_df=2).cache()
    best = {r.id: r.term for r in most_distinctive(scored, 1).collect()}
    assert best == {f"d{k}": f"rare{k % 3}" for k in range(9)}
    by_count = {r.id: r.term for r in most_distinctive(scored.withColumn("z", scored.tf.cast("double")), 1).collect()}
    assert all(by_count[f"d{k}"] != best[f"d{k}"] for k in range(9))


def test_empty_table(spark):
    assert distinctive_terms(frame(spark, []), "id", "text").count() == 0


@given(st.text())
def test_tokens_are_letters_and_digits(text):
    assert all(t.isalnum() for t in tokens_of(text))
