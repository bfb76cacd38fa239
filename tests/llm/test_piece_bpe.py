import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm.piece_bpe import PieceBpe, digests, tokenize

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
OURS = PieceBpe(PATH)
EDGES = [
    "", " ", "  ", "a", " a", "a  b ", "▁ x▁▁y", "\n\n a\tb\r\n", "x" * 500, " " * 100 + "b", "<s> </s> <unk> <0x41>",
    "日本語テスト", "😀 smile 👩‍👩‍👧", "\x00x", "é́ ﷺ ÃÂ", "https://www.example.com/a?b=c&d=%20", "=" * 40 + "-" * 33, "ab" * 300,
]


def agree(text):
    ids = LIBRARY.encode(text)
    assert OURS.encode(text) == ids
    decoded = LIBRARY.decode(ids)
    assert OURS.decode(ids) == decoded
    assert OURS.encode_and_decode(text) == (len(ids), ",".join(map(str, ids)), decoded)


@pytest.mark.parametrize("text", EDGES)
def test_edges(text):
    agree(text)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("aeinorstABab01 .,-=/<>▁\né日😀́"), max_size=60))
def test_mixed_text(text):
    agree(text)


def test_joined_pieces():
    draw = random.Random(3)
    pieces = [LIBRARY.id_to_piece(i) for i in range(259, 32000)]
    for _ in range(2000):
        agree("".join(draw.choices(pieces, k=draw.randint(1, 10))).replace("▁", " "))


def test_any_ids_decode():
    draw = random.Random(5)
    for _ in range(1000):
        ids = [draw.randrange(32000 if draw.random() < 0.5 else 260) for _ in range(draw.randint(1, 8))]
        assert OURS.decode(ids) == LIBRARY.decode(ids)


def test_neighbours_fit_exactly_in_encodings():
    """The rule behind the backtracking: in an encoding each pair of neighbours is its own encoding."""
    for text in ("the rethinking of unbelievable thingsthatnobodyhas", "aaaaaaaaaaaaaaabbbbbbbbbbbb"):
        ids = OURS.encode(text)
        assert all(OURS.fits(a, b) for a, b in zip(ids, ids[1:]))


def test_full_caches_change_nothing(monkeypatch):
    monkeypatch.setattr("ledgerline.llm.piece_bpe.CACHED_CHUNKS", 3)
    monkeypatch.setattr("ledgerline.llm.piece_bpe.CACHED_PAIRS", 2)
    own = PieceBpe(PATH)
    text = " ".join(f"word{i % 17} thing{i % 5}, and" for i in range(300))
    assert own.encode_and_decode(text)[1] == ",".join(map(str, LIBRARY.encode(text)))


def test_tables(documents):
    rows = [(1, None), (2, ""), (None, "null id"), (3, "same"), (3, "same"), (4, "long " * 20_000), (5, "x" * 3000)]
    by_text = {t: LIBRARY.encode(t or "") for _, t in rows}
    found = tokenize(documents(rows), PATH).collect()
    assert sorted((str(r["doc_id"]), r["ids"], r["decoded"], r["n_tokens"], r["base"]) for r in found) == sorted(
        (str(d), by_text[t], LIBRARY.decode(by_text[t]), len(by_text[t]), "?") for d, t in rows
    )
    short = {r["doc_id"]: r for r in digests(documents(rows), PATH).collect()}
    assert short[1]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert short[4]["ids_sha256"] == hashlib.sha256(",".join(map(str, by_text[rows[5][1]])).encode()).hexdigest()
    assert digests(documents([]), PATH).count() == 0


def test_whole_table(spark, sf_dir):
    from ledgerline.llm.queries import QUERIES

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = QUERIES["op4_sentencepiece"](spark, sf_dir).collect()
    assert len(found) == len(texts)
    for row in found:
        ids = LIBRARY.encode(texts[row["doc_id"]])
        decoded = LIBRARY.decode(ids).encode()
        assert row["n_tokens"] == len(ids) and row["decoded_sha256"] == hashlib.sha256(decoded).hexdigest()
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
