"""Column expressions shared by the jobs. All are safe in ANSI mode: bad text gives null."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Node price and size, executor size, date pattern, strategy names.
NODE_USD_PER_HOUR = 0.09576
NODE_MILLICORES = 2000
NODE_MIB = 8192
EXECUTOR_MILLICORES = 1000
EXECUTOR_MIB = 512
SALE_DATE_PATTERN = "yyyy-MM-dd HH:mm"
STRATEGY_LABELS = {
    "dynamic": "Dynamic Alloc",
    "dra": "Dynamic Alloc",
    "keda": "KEDA",
    "hpa": "HPA",
}

INTEGER_TEXT = r"^\s*[+-]?\d+\s*$"
DECIMAL_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
PLAIN_COUNT_TEXT = r"^[0-9]+$"


def to_long(text: Column) -> Column:
    return text.try_cast("bigint")


def to_float(text: Column) -> Column:
    """32-bit on purpose: the width shows in the averages."""
    return text.try_cast("float")


def strict_integer(text: Column, dtype="bigint") -> Column:
    """Whole-number text only; "2.0" is null. The pattern keeps bad text away from the slower cast."""
    return F.when(text.rlike(INTEGER_TEXT), F.trim(text).try_cast(dtype))


def strict_decimal(text: Column) -> Column:
    """Plain or exponent notation; words such as nan or inf are null."""
    return F.when(text.rlike(DECIMAL_TEXT), F.trim(text).try_cast("double"))


def count_or_zero(text: Column) -> Column:
    """A reading that is not made of digits only counts as 0."""
    return F.coalesce(F.when(text.rlike(PLAIN_COUNT_TEXT), text.try_cast("bigint")), F.lit(0))


def sale_year(text: Column) -> Column:
    return F.year(F.try_to_timestamp(text, F.lit(SALE_DATE_PATTERN)))


def clean_name(text: Column) -> Column:
    return F.lower(F.trim(text))


def strategy_name(text: Column) -> Column:
    name = clean_name(text)
    return F.when(name == "dynamic", F.lit("dra")).otherwise(name)


def strategy_label(name: Column) -> Column:
    label = F.lit(None).cast("string")
    for key, text in STRATEGY_LABELS.items():
        label = F.coalesce(label, F.when(name == key, F.lit(text)))
    return F.coalesce(label, name)


def percent(value: Column) -> Column:
    """Clamp to [0, 100]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), value))


def rounded_ratio(top: Column, bottom: Column, digits=2) -> Column:
    return F.round(F.try_divide(top, bottom), digits)


def weighted_score(avg_hours: Column, avg_ratio: Column, total: Column) -> Column:
    return avg_hours * avg_ratio * F.log(total + 1)


def cost_rate(cpu_millicores: Column, memory_mib: Column) -> Column:
    """USD per second of the dominant resource's share of one node; null when a reading is null."""
    share = F.greatest(cpu_millicores / NODE_MILLICORES, memory_mib / NODE_MIB)
    rate = share * (NODE_USD_PER_HOUR / 3600)
    return F.when(cpu_millicores.isNotNull() & memory_mib.isNotNull(), rate)


def non_negative(value: Column, field: str) -> Column:
    """The value itself; a negative one stops the job with the field named."""
    message = F.concat(F.lit(f"{field} is negative: "), value.cast("string"))
    return F.when(value < 0, F.raise_error(message).cast("double")).otherwise(value)
