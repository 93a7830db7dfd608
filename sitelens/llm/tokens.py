"""Encoding and decoding of whole corpora with a public vocabulary.

Texts are cut into pre-tokens with their positions, and only distinct words travel:
a block of documents carries each of its words once and refers to it by slot, the
distinct words of all blocks are encoded once each, the ids are joined back to the
blocks by word, and every document is put together again by position.  What is
shuffled is the vocabulary of the blocks, not the text.  Decoding runs the same way
over token ids, joined with the table of token bytes.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.session import materialize

#: Folder of the vocabulary files and the pre-token pattern of the byte-level vocabularies (fixed value of that format).
TOKENIZERS = os.environ.get("SITELENS_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A block ends when it has so many units (characters or ids); a longer document is a block of its own.
BLOCK_UNITS = 1_000_000
#: Fewest blocks a word must occur in for its ids to be broadcast.
LEAST_BLOCKS = 64
_BLOCKS = "block bigint, doc_id bigint, slots array<int>, slot int, word {word}"


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(maxsize=1)
def _pattern():
    import regex

    return regex.compile(PATTERN)


def _blocker(units: Callable[[object], list], count: Callable[[object], int]):
    """Rows of documents (doc_id, content) -> rows of blocks: one per document, one per distinct word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = TaskContext.get().partitionId() << 32
        seq, size = 0, 0
        docs: list[tuple[object, np.ndarray]] = []
        index: dict = {}

        def flush() -> pd.DataFrame:
            words = list(index)
            return pd.DataFrame({
                "block": np.full(len(docs) + len(words), first + seq, dtype=np.int64),
                "doc_id": pd.array([d for d, _ in docs] + [None] * len(words), dtype="Int64"),
                "slots": [s for _, s in docs] + [None] * len(words),
                "slot": pd.array([None] * len(docs) + list(range(len(words))), dtype="Int32"),
                "word": [None] * len(docs) + words,
            })

        for t in batches:
            for doc_id, content in zip(t["doc_id"].tolist(), t["content"]):
                found = units(content) if content is not None else []
                slots = np.fromiter((index.setdefault(w, len(index)) for w in found), dtype=np.int32, count=len(found))
                docs.append((doc_id, slots))
                size += count(content) if content is not None else 0
                if size >= BLOCK_UNITS:
                    yield flush()
                    seq, size, docs, index = seq + 1, 0, [], {}
        if docs:
            yield flush()

    return run


def _blocks(df: DataFrame, word: str, units, count) -> tuple[DataFrame, DataFrame]:
    out = materialize(df.mapInPandas(_blocker(units, count), _BLOCKS.format(word=word)), "token-blocks")
    return out.where("slot is null").select("block", "doc_id", "slots"), out.where("slot is not null").select(F.col("block").alias("block"), "slot", "word")


def _words(text: str) -> list[str]:
    return _pattern().findall(text)


def _encoder(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(path)
        for t in batches:
            yield pd.DataFrame({"word": t["word"], "n": t["n"], "ids": enc.encode_ordinary_batch(t["word"].tolist(), num_threads=1)})

    return run


def _put_together(docs: pd.DataFrame, words: pd.DataFrame, make: Callable[[np.ndarray, pd.Series], list]) -> list:
    """make(slots, values by slot) for each document of one block."""
    values = pd.Series(words["value"].to_numpy(), index=words["slot"].to_numpy()).sort_index().tolist()
    return make(docs["slots"].tolist(), values)


def _join_ids(slots: list, values: list) -> list:
    lens = np.array([len(v) for v in values], dtype=np.int64)
    flat = np.concatenate(values).astype(np.int32) if len(values) else np.zeros(0, np.int32)
    start = np.cumsum(lens) - lens
    out = []
    for s in slots:
        n = lens[s]
        at = np.repeat(start[s] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        out.append(flat[at])
    return out


def _assemble_ids(docs: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"doc_id": docs["doc_id"], "ids": _put_together(docs, words, _join_ids)})


def _assemble_counts(docs: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
    made = _put_together(docs, words, lambda slots, v: [int(np.asarray(v, dtype=np.int64)[s].sum()) if len(s) else 0 for s in slots])
    return pd.DataFrame({"doc_id": docs["doc_id"], "n_tokens": made})


def _assemble_text(docs: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
    made = _put_together(docs, words, lambda slots, v: [b"".join([v[i] for i in s]).decode("utf-8", "replace") for s in slots])
    return pd.DataFrame({"doc_id": docs["doc_id"], "text": made})


def _encoded(documents: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Documents by block, and (block, slot, ids): each distinct word of the corpus encoded once.

    A word that occurs in a tenth of all blocks or more would bring that many rows to
    one task.  There are at most ten times as many such words as a block has on average
    (``BLOCK_UNITS`` bounds it), so their ids are broadcast; all others meet by a shuffle.
    """
    docs, words = _blocks(documents.select("doc_id", F.col("text").alias("content")), "string", _words, len)
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    once = materialize(counted.mapInPandas(_encoder(path), "word string, n bigint, ids array<int>"), "token-words")
    common = F.col("n") >= max(LEAST_BLOCKS, docs.select("block").distinct().count() / 10)
    hot, rest = F.broadcast(once.where(common).select("word", "ids")), once.where(~common).select("word", "ids")
    met = words.join(hot.select("word"), "word", "left_anti").join(rest, "word").unionByName(words.join(hot, "word"))
    return docs, met.select("block", "slot", "ids")


def _gather(docs: DataFrame, values: DataFrame, function, schema: str) -> DataFrame:
    """Bring documents and words of each block together; a block is bounded by BLOCK_UNITS and one document."""
    return docs.groupBy("block").cogroup(values.groupBy("block")).applyInPandas(function, schema)


def encode(documents: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) for every document: token ids without special tokens.

    The strings of special tokens in a text are ordinary text.  Empty and null texts
    have no ids (an empty list).  A document that occurs in several rows has as many rows.
    """
    docs, ids = _encoded(documents, f"{folder}/{vocabulary}")
    return _gather(docs, ids.withColumnRenamed("ids", "value"), _assemble_ids, "doc_id bigint, ids array<int>")


def token_counts(documents: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens); empty and null texts have none."""
    docs, ids = _encoded(documents, f"{folder}/{vocabulary}")
    return _gather(docs, ids.select("block", "slot", F.size("ids").alias("value")), _assemble_counts, "doc_id bigint, n_tokens bigint")


def token_table(spark: SparkSession, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(word, value): the bytes of every token id; as many rows as the vocabulary file has."""
    rows = [(i, bytearray(b)) for b, i in ranks(f"{folder}/{vocabulary}").items()]
    return spark.createDataFrame(rows, "word int, value binary")


def decode(encoded: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from (doc_id, ids): the inverse of ``encode``; no ids give the empty text.

    Ids outside the vocabulary have no bytes and are left out.
    """
    docs, words = _blocks(encoded.select("doc_id", F.col("ids").alias("content")), "int", lambda ids: ids.tolist(), len)
    known = words.join(token_table(encoded.sparkSession, folder, vocabulary), "word", "left")
    known = known.select("block", "slot", F.coalesce("value", F.lit(bytearray())).alias("value"))
    return _gather(docs, known, _assemble_text, "doc_id bigint, text string")
