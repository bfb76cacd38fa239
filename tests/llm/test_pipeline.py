"""The pipeline stage by stage against plain versions, each on the stage's own input."""

import public_tokenizers
import pytest
import sentencepiece
from test_decontamination import plain as contaminated
from test_line_dedup import plain as without_lines
from test_simhash import brute as fingerprint_groups

import corpus_pipeline
from ledgerline.sources.shared import written


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(written(stage(spark, tables[-1], sf_dir), "test"))
    return [[r.asDict() for r in t.collect()] for t in tables]


def pairs(rows):
    return [(r["doc_id"], r["text"]) for r in rows]


def test_columns_and_names(stages):
    assert all(set(rows[0]) == set(corpus_pipeline.COLUMNS) for rows in stages[:-1])
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language id", "line dedup", "simhash near-dedup", "benchmark decontamination", "sentencepiece",
    ]


def test_language_stage_keeps_documents(stages):
    before, after = stages[0], stages[1]
    assert 0.98 * len(before) <= len(after) and all(r in before for r in after)


def test_line_stage(stages):
    wanted = [(d, k) for d, _, n, k in without_lines(pairs(stages[1])) if not (n and not k.strip(" \t\r\n"))]
    assert sorted(pairs(stages[2])) == sorted(wanted)
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2])


def test_simhash_stage(stages):
    wanted = {d for d, component in fingerprint_groups(pairs(stages[2])) if d == component}
    assert {r["doc_id"] for r in stages[3]} == wanted and all(r in stages[2] for r in stages[3])


def test_decontamination_stage(spark, sf_dir, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    short = [(d, t) for d, t in pairs(stages[3]) if len(t) < 6000]
    kept = {r["doc_id"] for r in stages[4]}
    assert {d for d, *_, bad in contaminated(short, items) if not bad} == kept & {d for d, _ in short}
    assert all(r in stages[3] for r in stages[4])


def test_encoding_stage(stages):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = dict(pairs(stages[4]))
    assert len(stages[5]) == len(texts)
    assert all(r["ids"] == library.encode(texts[r["doc_id"]]) and r["n_tokens"] == len(r["ids"]) for r in stages[5])


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    found = [(r["doc_id"], r["ids"]) for r in corpus_pipeline.run(spark, sf_dir).collect()]
    assert sorted(found) == sorted((r["doc_id"], r["ids"]) for r in stages[-1])


def test_nulls_and_odd_rows_pass(spark, sf_dir):
    real = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(None, "The of and that.", "en", None, None), (-1, None, None, None, None), (-2, "", "en", "s", 0)], real.schema)
    docs = real.unionAll(odd)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir), "test")
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert None in ids and not {-1, -2} & ids


def test_one_row_of_each_group_is_kept(spark, sf_dir):
    real = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a, b, c, d = ("the quick brown fox jumps", "an entirely different text here", "third words of another kind", "fourth and last of these texts")
    ids = [(1, a), (1, a), (2, a), (2, b), (None, c), (None, c), (None, d), (5, d)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in ids], real.select(corpus_pipeline.COLUMNS).schema)
    left = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()
    assert sorted(pairs(r.asDict() for r in left), key=str) == sorted([(1, a), (2, b), (None, c), (5, d)], key=str)
