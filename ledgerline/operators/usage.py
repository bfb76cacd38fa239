"""Readings that arrive as text: metric answers in JSON and usage dumps in columns."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.scalars import DECIMAL_TEXT

ANSWER_TYPE = "data struct<result: array<struct<value: array<string>>>>"

# MiB per unit. Binary units as usual; decimal units by their SI size.
MIB_PER_UNIT = {
    "Ki": 1 / 1024,
    "Mi": 1.0,
    "Gi": 1024.0,
    "Ti": 1024.0 * 1024,
    "K": 1000 / 1048576,
    "M": 1000**2 / 1048576,
    "G": 1000**3 / 1048576,
    "T": 1000**4 / 1048576,
    "": 1 / 1048576,
}
CPU_TEXT = r"^(.*?)(m?)$"
MEMORY_TEXT = r"^(.*?)(Ki|Mi|Gi|Ti|K|M|G|T)?$"


def _number(text):
    return F.when(text.rlike(DECIMAL_TEXT), text.try_cast("double"))


def answer_total(answer_json):
    """Sum of the result values of one answer, truncated; null without results or with a bad one.

    The count travels with the sum, so that the answer is parsed once.
    """
    results = F.from_json(answer_json, ANSWER_TYPE).getField("data").getField("result")
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("n"))

    def add(acc, row):
        value = F.try_element_at(row["value"], F.lit(2)).try_cast("double")
        return F.struct((acc["total"] + value).alias("total"), (acc["n"] + 1).alias("n"))

    total = F.aggregate(results, start, add, lambda acc: F.when(acc["n"] > 0, acc["total"]))
    return total.try_cast("bigint")


def metric_answers(answers: DataFrame, json_col="answer", out="total") -> DataFrame:
    return answers.withColumn(out, answer_total(F.col(json_col))).drop(json_col)


def usage_dump(lines: DataFrame, scrape, line_col="line", mib_per_unit=None) -> DataFrame:
    """CPU millicores and memory MiB per scrape from lines ``name cpu memory``, truncated.

    Lines with too few columns are skipped for what they lack; an unreadable number makes the
    scrape's total null.
    """
    columns = F.split(F.trim(F.regexp_replace(line_col, r"\s+", " ")), " ")
    cpu_text, memory_text = F.get(columns, F.lit(1)), F.get(columns, F.lit(2))
    cpu_number = _number(F.regexp_extract("cpu_text", CPU_TEXT, 1))
    millicores = F.when(F.col("cpu_text").endswith("m"), cpu_number).otherwise(cpu_number * 1000)
    units = mib_per_unit or MIB_PER_UNIT
    unit_map = F.create_map(*[F.lit(item) for pair in units.items() for item in pair])
    unit = F.regexp_extract("memory_text", MEMORY_TEXT, 2)
    mib = _number(F.regexp_extract("memory_text", MEMORY_TEXT, 1)) * F.try_element_at(unit_map, unit)
    parsed = lines.select(*scrape, cpu_text.alias("cpu_text"), memory_text.alias("memory_text")).select(
        *scrape,
        "cpu_text",
        "memory_text",
        F.when(F.col("cpu_text").isNotNull(), millicores).alias("millicores"),
        F.when(F.col("memory_text").isNotNull(), mib).alias("mib"),
    )

    def total(value, text):
        unreadable = F.count_if(F.col(text).isNotNull() & F.col(value).isNull())
        return F.when(unreadable == 0, F.coalesce(F.sum(value), F.lit(0.0)).try_cast("bigint"))

    return parsed.groupBy(*scrape).agg(
        F.count(F.lit(1)).alias("lines"),
        total("millicores", "cpu_text").alias("cpu_millicores"),
        total("mib", "memory_text").alias("memory_mib"),
        F.count_if(F.col("cpu_text").isNull()).alias("skipped_cpu"),
        F.count_if(F.col("memory_text").isNull()).alias("skipped_memory"),
    )


def sample_fallback(primary: DataFrame, dump: DataFrame, keys) -> DataFrame:
    """Primary readings where both CPU and memory are known, else both from the dump (0 if none).

    Scrapes that only one side has are kept; each side has one row per scrape.
    """
    fallback = dump.select(
        *keys, F.col("cpu_millicores").alias("dump_cpu"), F.col("memory_mib").alias("dump_memory")
    )
    both = F.col("cpu_millicores").isNotNull() & F.col("memory_mib").isNotNull()

    def pick(name, other):
        return F.when(both, F.col(name)).otherwise(F.coalesce(F.col(other), F.lit(0))).alias(name)

    return primary.join(fallback, keys, "full").select(
        *keys,
        pick("cpu_millicores", "dump_cpu"),
        pick("memory_mib", "dump_memory"),
        F.when(both, "metrics").otherwise("usage dump").alias("source"),
    )
