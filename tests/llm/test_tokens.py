from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm.tokens import BYTE_BPE, decode_corpus, decode_ids, encode_corpus, encode_texts, vocabulary_path

PATH = vocabulary_path(BYTE_BPE)
ROWS = [(1, "Hello wörld 🧪 <|endoftext|>", 9), (2, "", 9), (3, None, 9), (4, " \r\n\t", 9), (5, "x" * 200000, 9), (5, "again", 9), (None, "e\u0301 新しい", 9)]
SCHEMA = "doc_id long, text string, ids int"


@settings(max_examples=60, deadline=None)
@given(st.text())
def test_round_trip(text):
    ids, start = encode_texts([text, None], PATH)
    assert decode_ids(ids[: start[1]].tolist(), PATH) == text
    assert start.tolist() == [0, len(ids), len(ids)]


def test_split_characters_meet_again():
    ids, _ = encode_texts(["🧪"], PATH)
    assert len(ids) > 1 and decode_ids(ids.tolist(), PATH) == "🧪"
    assert decode_ids(ids[:1].tolist(), PATH) == "\ufffd"


def test_table(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = encode_corpus(df, "doc_id", "text")
    back = decode_corpus(got, "id", "ids").collect()
    assert sorted((r.id is None, r.id, r.text) for r in back if r.id is not None) == sorted((False, i, t or "") for i, t, _ in ROWS if i is not None)
    assert all(r.ids == [] for r in got.where("id in (2, 3)").collect())
    assert max(i for r in got.collect() for i in r.ids) < 50256
    assert encode_corpus(df.limit(0), "doc_id", "text").count() == 0


def test_offsets(spark):
    text = "naïve 🧪 end"
    r = encode_corpus(spark.createDataFrame([(1, text, 1)], SCHEMA), "doc_id", "text", offsets=True).first()
    assert len(r.ids) == len(r.starts) == len(r.ends) and r.starts[0] == 0 and r.ends[-1] == len(text)
