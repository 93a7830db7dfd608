import pytest

from sitelens.llm import tokens

TEXTS = [None, "", " ", "\n\n  x", "Hello world's end, it's 42!", "don't  stop\t\tnow \r\n", "长持ちする本棚 и тихий чайник 🙂🛠️", "<|endoftext|> is text", "a" * 30000, "word " * 5000, "﻿BOM", "é ​", "one"]


@pytest.fixture
def frame(spark):
    return spark.createDataFrame([(i, t, 1, "c") for i, t in enumerate([*TEXTS, "one"])], "doc_id bigint, text string, slot int, word string")


def plain(text):
    return tokens._encoding(f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}").encode_ordinary(text or "")


def test_ids_equal_plain_encoding(frame, monkeypatch):
    want = {i: plain(t) for i, t in enumerate([*TEXTS, "one"])}
    assert {r["doc_id"]: r["ids"] for r in tokens.encode(frame).collect()} == want
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(frame).collect()} == {i: len(x) for i, x in want.items()}
    monkeypatch.setattr(tokens, "LEAST_BLOCKS", 1)  # every word is a common one
    assert {r["doc_id"]: r["ids"] for r in tokens.encode(frame).collect()} == want


def test_round_trip(frame, docs):
    for df in (frame, docs):
        want = {r["doc_id"]: r["text"] or "" for r in df.select("doc_id", "text").collect()}
        assert {r["doc_id"]: r["text"] for r in tokens.decode(tokens.encode(df)).collect()} == want


def test_empty_table_and_unknown_ids(spark, frame):
    assert tokens.encode(frame.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, [0, 10**6, 1])], "doc_id bigint, ids array<int>")
    assert tokens.decode(odd).first()["text"] == tokens.decode(spark.createDataFrame([(1, [0, 1])], "doc_id bigint, ids array<int>")).first()["text"]


def test_same_vocabulary_in_another_library(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    rows = docs.where("text is not null").select("doc_id", "text").collect()
    want = {r["doc_id"]: e.ids for r, e in zip(rows, t.encode_batch([r["text"] for r in rows], add_special_tokens=False))}
    got = {r["doc_id"]: r["ids"] for r in tokens.encode(docs.where("text is not null")).collect()}
    assert got == want
