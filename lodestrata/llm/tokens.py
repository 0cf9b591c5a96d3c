"""Encoding of a whole corpus with a public byte-level tokenizer, and back.

Texts are encoded with the tokenizers library, an Arrow batch at a time. The
library's offsets count characters; a character of several bytes may be split
over tokens, and then each of these tokens reports the whole character.
Decoding doesn't need the library: it reverses the byte table of the
vocabulary, so the bytes of split characters meet again.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import arrow_map, read

TOKENIZER_DIR = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k"


def vocabulary_path(name: str, folder: str = TOKENIZER_DIR) -> str:
    return os.path.join(folder, f"{name}.json")


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    t.no_padding()
    t.no_truncation()
    return t


@lru_cache(maxsize=1)
def byte_of_symbol() -> dict[str, int]:
    """The symbol that stands for each byte: printable Latin-1 for itself, the others counted on from U+0100."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    table = byte_of_symbol()
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    vocab = model["model"]["vocab"]
    special = {t["id"]: t["content"].encode() for t in model.get("added_tokens", [])}
    out = [b""] * (1 + max([*vocab.values(), *special], default=-1))
    for symbol, i in vocab.items():
        if i not in special:
            out[i] = bytes(table[c] for c in symbol)
    for i, raw in special.items():
        out[i] = raw
    return out


def decode_ids(ids: list[int], path: str) -> str:
    """The text of a list of ids. Bytes that form no whole character become U+FFFD."""
    known = token_bytes(path)
    return b"".join(known[i] for i in ids).decode("utf-8", errors="replace")


SLICE = 256


def encode_texts(texts: list[str | None], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one array, and where each text's ids start."""
    t = tokenizer(path)
    parts, counts = [], np.zeros(len(texts), np.int64)
    for at in range(0, len(texts), SLICE):
        some = t.encode_batch_fast([x or "" for x in texts[at : at + SLICE]], add_special_tokens=False)
        for i, e in enumerate(some):
            counts[at + i] = len(e.ids)
            parts.append(np.array(e.ids, np.int32))
    return np.concatenate(parts) if parts else np.zeros(0, np.int32), np.concatenate([[0], np.cumsum(counts)])


def encode_corpus(df: DataFrame, id_col: str, text_col: str, name: str = BYTE_BPE, folder: str = TOKENIZER_DIR, offsets: bool = False) -> DataFrame:
    """(id, ids) of each row, or (id, ids, starts, ends) with character offsets.

    Nothing is added to a text's ids; strings that look like special tokens are
    ordinary text. An empty text and a null text have the empty list. Each row
    comes out once, whatever else the table holds; there is no shuffle.
    """
    path = vocabulary_path(name, folder)
    src = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def encode(batch: pa.RecordBatch):
        for at in range(0, len(batch), 1024):
            part = batch.slice(at, 1024)
            texts = part.column("text").to_pylist()
            if not offsets:
                flat, start = encode_texts(texts, path)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(flat))], names=["id", "ids"])
            else:
                some = tokenizer(path).encode_batch([x or "" for x in texts], add_special_tokens=False)
                lists = [pa.array([f(e) for e in some], pa.list_(pa.int32())) for f in (lambda e: e.ids, lambda e: [a for a, _ in e.offsets], lambda e: [b for _, b in e.offsets])]
                yield pa.RecordBatch.from_arrays([part.column("id"), *lists], names=["id", "ids", "starts", "ends"])

    kind = dict(src.dtypes)["id"]
    extra = ", starts array<int>, ends array<int>" if offsets else ""
    return arrow_map(src, encode, f"id {kind}, ids array<int>{extra}")


def decode_corpus(df: DataFrame, id_col: str, ids_col: str, name: str = BYTE_BPE, folder: str = TOKENIZER_DIR) -> DataFrame:
    """(id, text) of each row of ids; a null list gives a null text."""
    path = vocabulary_path(name, folder)
    src = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{ids_col}`").alias("ids"))

    def decode(batch: pa.RecordBatch):
        texts = [None if ids is None else decode_ids(ids, path) for ids in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    return arrow_map(src, decode, f"id {dict(src.dtypes)['id']}, text string")


def token_counts(df: DataFrame, id_col: str, text_col: str, name: str = BYTE_BPE, folder: str = TOKENIZER_DIR) -> DataFrame:
    """(id, n_tokens) of each row."""
    path = vocabulary_path(name, folder)
    src = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def count(batch: pa.RecordBatch):
        _, start = encode_texts(batch.column("text").to_pylist(), path)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(start), pa.int64())], names=["id", "n_tokens"])

    return arrow_map(src, count, f"id {dict(src.dtypes)['id']}, n_tokens long")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document by byte_bpe_50k."""
    return encode_corpus(read(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text from its ids; a null text had no ids, so it comes back empty."""
    ids = encode_corpus(read(spark, sf_dir, "documents"), "doc_id", "text")
    return decode_corpus(ids, "id", "ids").withColumnRenamed("id", "doc_id")


QUERIES = {"p8_ids": p8_ids, "p8_decoded": p8_decoded}
ORACLES = {"p8_decoded": "select doc_id, coalesce(text, '') as text from documents"}
