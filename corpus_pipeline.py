"""A corpus from raw documents: STAGES in order, each over all that its predecessor kept."""

import public_tokenizers
from pyspark.sql import functions as F

from ledgerline.llm import decontamination, langid, line_dedup, piece_bpe, simhash
from ledgerline.llm.texts import ID, KEY, TEXT, same
from ledgerline.sources.packages import send_package
from ledgerline.sources.shared import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def known_language(spark, docs, sf_dir):
    """Keeps the documents whose language is told with the calibrated least score; learns from ``docs`` itself.

    Null texts and texts without a letter have no language and go. Each row is judged by its text alone, so repeated
    rows stay or go together.
    """
    send_package(spark)
    found = langid.identify(docs.select(COLUMNS), rows_a_language=600, most_languages=256)
    return found.where("accepted").select(COLUMNS)


def drop_repeated_lines(spark, docs, sf_dir):
    """Removes passages of three lines that an earlier document has; a document with nothing left goes.

    Earlier is by (doc_id, text digest), null ids first. Rows that agree in both lose the same lines; empty texts have none
    to lose and stay.
    """
    found = line_dedup.dedup_lines(docs.select(COLUMNS))
    emptied = (F.col("n_removed") > 0) & (F.trim(F.col(TEXT), F.lit(" \t\r\n")) == "")
    return found.where(~emptied).withColumn("n_chars", F.length(TEXT).cast("long")).select(COLUMNS)


def drop_near_duplicates(spark, docs, sf_dir):
    """Keeps one row of each group of near-duplicates; see ``simhash.one_of_each`` for which one, and for nulls and repeats."""
    send_package(spark)
    return simhash.one_of_each(docs.select(COLUMNS), shingle_words=3, max_bits=2)


def drop_contaminated(spark, docs, sf_dir):
    """Drops documents of which a twentieth of the words or more is in passages of the benchmark.

    Rows that agree in id and text go or stay together; null and empty texts have no words and stay.
    """
    send_package(spark)
    found = decontamination.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    dirty = found.where("contaminated").select(ID, KEY)
    named = docs.select(COLUMNS).withColumn(KEY, F.xxhash64(F.coalesce(F.col(TEXT).cast("string"), F.lit(""))))
    return named.join(dirty, same(named, dirty, [ID, KEY]), "left_anti").select(COLUMNS)


def encode(spark, docs, sf_dir):
    """Token ids of every document, and a digest of the text that they decode to; null text counts as empty, every row stays."""
    send_package(spark)
    found = piece_bpe.tokenize(docs.select(COLUMNS), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.sha2("decoded", 256).alias("decoded_sha256")
    return found.select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids", digest)


STAGES = [
    ("language id", known_language),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("sentencepiece", encode),
]


def run(spark, sf_dir):
    """The rows of the last stage, from the table ``documents``; every stage is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Fingerprints, tokens and a trained classifier have no form in SQL; tests/llm compares with a plain version.
ORACLE_SQL = None
