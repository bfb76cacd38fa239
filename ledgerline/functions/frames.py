"""Small DataFrame helpers."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match_nulls_join(left: DataFrame, right: DataFrame, keys, how="inner") -> DataFrame:
    """Equi-join on ``keys`` in which null equals null; keeps the left side's key columns."""
    hidden = {key: f"__right_{key}" for key in keys}
    renamed = right.withColumnsRenamed(hidden)
    condition = reduce(
        lambda a, b: a & b, [left[key].eqNullSafe(renamed[name]) for key, name in hidden.items()]
    )
    return left.join(renamed, condition, how).drop(*hidden.values())


def salted_join(left: DataFrame, right: DataFrame, keys, spread, salts=16) -> DataFrame:
    """Inner equi-join in which a hot key of ``left`` is dealt over ``salts`` tasks by a hash of ``spread``.

    For a small ``right`` that was aggregated by the same keys: its rows are repeated ``salts`` times. Without
    that, Spark would take over the aggregate's partitioning, and a hot key could not be split.
    """
    dealt = left.withColumn("_salt", F.pmod(F.hash(*spread), F.lit(salts)))
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(repeated, [*keys, "_salt"]).drop("_salt")


def rounded(df: DataFrame, digits=6, **digits_of) -> DataFrame:
    """Round every floating column, so that summation order does not show; ``digits_of`` by column."""
    return df.select(
        *[
            F.round(F.col(name), digits_of.get(name, digits)).alias(name)
            if dtype in ("double", "float")
            else F.col(name)
            for name, dtype in df.dtypes
        ]
    )


def require_columns(df: DataFrame, columns, what="input") -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} missing required columns: {missing}")
