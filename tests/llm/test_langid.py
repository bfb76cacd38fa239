import math
import unicodedata
import zlib

import numpy as np
import pytest

from ledgerline.llm import langid


@pytest.fixture(scope="module")
def labelled(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")


@pytest.fixture(scope="module")
def model(labelled):
    return langid.train(labelled)


def test_held_out_accuracy(spark, sf_dir):
    from ledgerline.llm.queries import QUERIES

    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op9_language_id"](spark, sf_dir).collect()
    assert {r["doc_id"] for r in rows} == set(truth)
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held) > 0
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["accepted"] for r in rows) >= 0.99 * len(rows)


def test_held_out_rows_teach_nothing(spark, labelled, model):
    rows = labelled.collect()
    wrong = [(r["doc_id"], r["text"], "xx" if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 else r["lang"]) for r in rows]
    other = langid.train(spark.createDataFrame(wrong, "doc_id long, text string, lang string"))
    assert other.languages == model.languages and np.allclose(other.scores, model.scores)


def test_edges(documents, model):
    rows = [
        (1, None, "en"), (2, "", "de"), (3, "12 34 !? \n", "fr"), (4, "½ ² …", None), (None, "The of and that", None),
        (5, "The of and that", "xx"), (5, "The of and that", "xx"), (6, "The of and that " * 50_000, "en"), (7, "你好世界", None), (8, "qzx vkw jjq", None),
    ]
    found = langid.identify(documents(rows), model).collect()
    by_id = {r["doc_id"]: r for r in found}
    assert len(found) == 10 and {r["base"] for r in found} == {"?"}
    for nothing in (1, 2, 3, 4):
        assert (by_id[nothing]["lang_pred"], by_id[nothing]["score"], by_id[nothing]["accepted"]) == ("und", 0.0, False)
    assert by_id[None]["lang_pred"] == by_id[5]["lang_pred"] == by_id[6]["lang_pred"] == "en" and by_id[6]["accepted"]
    assert by_id[7]["lang_pred"] in model.languages and not by_id[7]["accepted"]


def test_counts_do_not_depend_on_blocks(monkeypatch):
    text = "Some Été text, with\twords. " * 40
    whole = langid.subword_counts(text)
    monkeypatch.setattr(langid, "BLOCK", 7)
    assert np.array_equal(whole, langid.subword_counts(text))


def test_nothing_to_learn(documents):
    assert documents([]).transform(langid.identify).count() == 0
    rows = langid.identify(documents([(1, "text", None), (2, None, "en")])).collect()
    assert {r["lang_pred"] for r in rows} == {"und"}


def test_one_language(documents):
    ids = [i for i in range(30) if zlib.crc32(str(i).encode()) % 3 != 1]
    found = langid.identify(documents([(i, f"words of one kind {i}", "en") for i in ids])).collect()
    assert {(r["lang_pred"], r["score"]) for r in found} == {("en", 1.0)}


def plain_predict(model, text):
    """Language and score by looping over the grams of each word and a softmax by hand."""
    if not any(unicodedata.category(c).startswith("L") for c in text or ""):
        return "und", 0.0
    kept = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in text.encode())
    spaced = b" " + b" ".join(kept.split()) + b" "
    logits, grams = [0.0] * len(model.languages), 0
    for n in (2, 3, 4):
        for at in range(len(spaced) - n + 1):
            gram = spaced[at : at + n]
            if 32 in gram[1:-1]:
                continue
            value = n
            for b in gram:
                value = (value * 0x01000193 + b) % 2**32
            row = model.scores[value * 0x9E3779B1 % 2**32 >> 32 - 13]
            logits = [x + y for x, y in zip(logits, row)]
            grams += 1
    raised = [math.exp((x / max(1, grams) + b) / model.temperature) for x, b in zip(logits, model.bias)]
    best = max(range(len(raised)), key=lambda k: (raised[k], -k))
    return model.languages[best], raised[best] / sum(raised)


def test_predictions_equal_a_plain_version(labelled, model):
    rows = [r for r in langid.identify(labelled, model).collect() if len(r["text"] or "") < 3000][:150]
    for r in rows:
        language, score = plain_predict(model, r["text"])
        assert r["lang_pred"] == language and r["score"] == pytest.approx(score, abs=1e-9)


def test_training_rows_are_sparse_and_in_a_fixed_order(labelled, model):
    dense = np.zeros((3, langid.BUCKETS), np.float32)
    dense[0, 5], dense[0, 9], dense[2, 8191] = 0.25, 0.75, 1
    shares = langid.Shares(np.array([0, 2, 2, 3]), np.array([5, 9, 8191]), np.array([0.25, 0.75, 1], np.float32))
    assert len(shares) == 3 and np.array_equal(shares.rows([0, 1, 2]), dense) and np.array_equal(shares.rows([2, 0]), dense[[2, 0]])
    again = langid.train(labelled.repartition(5))
    assert np.array_equal(again.scores, model.scores) and again.least_score == model.least_score
