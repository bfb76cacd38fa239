"""Shared pieces of the text operators."""

import ctypes
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns whose names begin with _llm_ are the operators' own; those of an input are not kept.
ID, TEXT, KEY = "doc_id", "text", "_llm_text_key"


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null becomes empty) and KEY, a 64-bit digest of the text.

    (doc_id, KEY) names a document: rows that agree in id and text are one document and get the
    same result, rows with one id and different texts do not mix, and a null id is an id of its own.
    Other columns are left behind, so their names cannot clash.
    """
    text = F.coalesce(F.col(TEXT).cast("string"), F.lit(""))
    return docs.select(F.col(ID).cast("long").alias(ID), text.alias(TEXT)).withColumn(KEY, F.xxhash64(TEXT))


def same(left: DataFrame, right: DataFrame, names):
    """Join condition: equal columns, null equal to null."""
    return reduce(lambda a, b: a & b, [left[name].eqNullSafe(right[name]) for name in names])


def attach(docs: DataFrame, found: DataFrame, names=(ID, KEY)) -> DataFrame:
    """Left join of ``docs`` with one row per document of ``found``, keeping the keys of ``docs``."""
    hidden = found.withColumnsRenamed({name: f"_llm_found_{name}" for name in names})
    condition = reduce(
        lambda a, b: a & b, [docs[name].eqNullSafe(hidden[f"_llm_found_{name}"]) for name in names]
    )
    return docs.join(hidden, condition, "left").drop(*[f"_llm_found_{name}" for name in names])


def release_memory():
    """Give memory that this Python worker has freed back to the system; workers live on for other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only the GNU library has it
        pass
