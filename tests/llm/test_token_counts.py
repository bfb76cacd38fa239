import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerline.llm import token_counts as ops

PATH = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = [
    "a", "B", "'s", "'", "re", "12", "9", " ", "\n", "\t", "́", "é", "é", "。", "中", "，", "　", "\x1c", "\x85", "\xa0", "!", "...",
    "<|startoftext|>", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "İ", "Σ", "가", "ᆨ", "ᄀ", "ᅡ", "Ω", "क़", "\U0001f600", "\r\n", "ll", "‍", "ﬁ",
]


def library(texts):
    tokenizer = Tokenizer.from_file(PATH)
    return [len(tokenizer.encode(text or "", add_special_tokens=False).ids) for text in texts]


def encode(parts):
    return [len(found.ids) for found in Tokenizer.from_file(PATH).encode_batch(parts, add_special_tokens=False)]


@pytest.mark.parametrize("seed", range(3))
def test_pieces_count_like_the_whole_text(seed, monkeypatch):
    monkeypatch.setattr(ops, "LONG_PIECE", 5)
    rng = random.Random(seed)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    assert ops.counted(texts, encode).tolist() == library(texts)


def test_slices_are_balanced_by_bytes():
    assert list(ops.slices(np.array([5, 5, 30, 1, 1, 1]), 10)) == [(0, 2), (2, 3), (3, 6)]
    assert list(ops.slices(np.array([], np.int64), 10)) == []
    assert list(ops.slices(np.array([0, 0]), 10)) == [(0, 2)]


def test_edges(spark, documents):
    texts = [None, "", " \n", "Hello  World", "x" * 70_000, "1" * 9000, "中文。" * 3000, "a <|endoftext|> b", "word " * 2048, "word " * 2049]
    docs = documents([(k if k else None, text) for k, text in enumerate(texts)] * 2).withColumnRenamed("n_words", "n_tokens")
    result = ops.count_tokens(docs, PATH)
    rows = result.collect()
    assert len(rows) == 2 * len(texts)
    want = {(t, len((t or "").encode()), n, n > 2048) for t, n in zip(texts, library(texts))}
    assert {(r["text"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows} == want
    assert ops.count_tokens(documents([]), PATH).count() == 0
    assert "n_lines" in result.columns and result.columns.count("n_tokens") == 1


def test_only_json(documents):
    with pytest.raises(ValueError, match="json"):
        ops.count_tokens(documents([]), "x.model")


def test_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = ops.count_tokens(docs.select("doc_id", "text"), PATH).collect()
    assert [r["n_tokens"] for r in rows] == library([r["text"] for r in rows])
