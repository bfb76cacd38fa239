"""The shapes the jobs expect, derived from the star-schema and event tables.

Each function is a row-local or join-only view over whole tables.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.series import (
    CPU_COUNTER,
    HEAP_MAX,
    HEAP_USED,
    PROCESS_CPU_COUNTER,
    UP,
    WORKING_SET,
)

# One second on the sample clock is this many seconds of event time, which puts the samples
# of a run about ten seconds apart.
CLOCK = 4320
USERS_PER_RUN = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviews(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_partkey").alias("app_id"),
        F.col("o_custkey").alias("user_id"),
        F.when(F.col("l_returnflag") == "N", "true").otherwise("false").alias("is_recommended"),
        F.col("l_quantity").cast("float").alias("hours"),
    )


def games(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("app_id"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("rating"),
        F.col("p_size").cast("float").alias("positive_ratio"),
    )


def users(spark, sf_dir) -> DataFrame:
    owned = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("products"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return customers.join(owned, F.col("user_id") == F.col("o_custkey"), "left").select(
        "user_id", F.coalesce("products", F.lit(0)).alias("products")
    )


def _located_orders(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(
        nations, F.col("c_nationkey") == F.col("n_nationkey")
    )


def sales(spark, sf_dir) -> DataFrame:
    """Cleaned sales: price and year typed."""
    return _located_orders(spark, sf_dir).select(
        F.col("o_totalprice").cast("bigint").alias("price"),
        F.year("o_orderdate").alias("year"),
        F.col("o_orderpriority").alias("property_type"),
        F.col("c_mktsegment").alias("district"),
        F.col("n_name").alias("county"),
    )


def raw_sales(spark, sf_dir) -> DataFrame:
    """Sales as text. Pending orders have no price yet, unspecified priorities no usable date."""
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm")
    return _located_orders(spark, sf_dir).select(
        F.col("o_orderkey").cast("string").alias("transaction_id"),
        F.when(F.col("o_orderstatus") == "P", "NOT_A_NUM")
        .otherwise(F.col("o_totalprice").cast("bigint").cast("string"))
        .alias("price"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "INVALID_DATE").otherwise(stamp).alias("date_of_transfer"),
        F.col("o_orderpriority").alias("property_type"),
        F.col("c_mktsegment").alias("district"),
        F.col("n_name").alias("county"),
    )


def events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events")


def event_stream(spark, sf_dir) -> DataFrame:
    """The same rows through a file stream. The glob also matches a folder of that name."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")


def arrivals(events: DataFrame, slices: int, delayed=0) -> list[DataFrame]:
    """The events as they arrive: a frame for each of ``slices`` equal spans of time, in order.

    With ``delayed``, each event whose id is divisible by it comes one frame later, so there is one frame more.
    """
    low, high = events.agg(F.min(_clock()), F.max(_clock())).first()
    if low is None:
        return [events]
    place = F.floor((_clock() - low) * slices / (high - low + 1))
    place = place + F.when(F.col("event_id") % delayed == 0, 1).otherwise(0) if delayed else place
    return [events.filter(place == k) for k in range(slices + bool(delayed))]


def _clock():
    return F.floor(F.unix_timestamp("ts") / CLOCK)


def _k():
    return F.get_json_object("props", "$.k").cast("int")


def _run_number():
    return F.expr(f"user_id div {USERS_PER_RUN}")


def _strategy():
    kind = F.col("event_type")
    return F.when(kind.isin("click", "signup"), "dra").when(kind == "purchase", "hpa").otherwise("keda")


def samples(events: DataFrame) -> DataFrame:
    """One resource sample per event; a few users make a run."""
    return events.select(
        F.concat(F.lit("run-"), _run_number().cast("string")).alias("run_id"),
        _strategy().alias("strategy"),
        _clock().alias("timestamp"),
        F.floor(F.col("value") / 50).cast("int").alias("executor_count"),
        (F.floor(F.col("value") / 10) * 150).cast("double").alias("cpu_millicores"),
        (F.floor(_k() / 10) * 512).cast("double").alias("memory_mib"),
    )


def raw_samples(events: DataFrame) -> DataFrame:
    """Samples as text with the faults of a collector: odd names, words, fractions, gaps, negatives."""
    kind, value = F.col("event_type"), F.col("value")
    strategy = (
        F.when(kind == "click", " Dynamic ")
        .when(kind == "signup", "dra")
        .when(kind == "view", "keda")
        .when(kind == "error", "KEDA")
        .otherwise("hpa")
    )
    executors = F.floor(value / 50).cast("string")
    return events.select(
        "event_id",
        F.concat(
            F.date_format("ts", "yyyyMMdd"), F.lit("-"), F.format_string("%06d", _run_number()),
            F.lit("-steam_heavy.csv"),
        ).alias("file"),
        strategy.alias("strategy"),
        _clock().cast("string").alias("timestamp"),
        F.when(value >= 300, F.concat(executors, F.lit(".5"))).otherwise(executors).alias("executor_count"),
        F.when(value < 2, "warning-text")
        .otherwise(F.floor((value - 5) * 20).cast("string"))
        .alias("cpu_millicores"),
        F.when(~value.between(60, 62), F.floor(value * 7).cast("string")).alias("memory_mib"),
    )


def metrics(events: DataFrame) -> DataFrame:
    """Long metric rows by pod: two CPU counters that restart, memory, heap and liveness gauges.

    Readings are multiples of powers of two, so that sums of them are exact.
    """
    kind = F.col("event_type")
    prefix = (
        F.when(kind.isin("click", "signup"), "spark-dynamic-")
        .when(kind == "purchase", "spark-worker-hpa-")
        .otherwise("spark-worker-keda-")
    )
    base = events.select(
        F.concat(prefix, F.col("user_id").cast("string")).alias("pod"),
        F.when(kind == "error", "POD").otherwise("spark-worker").alias("container"),
        F.when(kind == "signup", "nonheap").otherwise("heap").alias("area"),
        _clock().alias("ts"),
        "value",
        _k().alias("k"),
    )
    used = (F.col("ts") % 120).cast("double")
    readings = {
        CPU_COUNTER: used * 0.5 + F.floor(F.col("value") / 8) / 8,
        PROCESS_CPU_COUNTER: used * 0.25 + F.col("k") / 8,
        WORKING_SET: F.col("k") * 4194304.0,
        HEAP_USED: F.col("k") * 5000000.0,
        HEAP_MAX: F.lit(536870912.0),
        UP: F.when(F.col("value") >= 10, 1.0).otherwise(0.0),
    }
    parts = [
        base.select(F.lit(name).alias("metric"), "pod", "container", "area", "ts", value.alias("value"))
        for name, value in readings.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def _scrape_columns():
    return [
        _strategy().alias("strategy"),
        (F.floor(F.unix_timestamp("ts") / 3600) * 3600).alias("timestamp"),
    ]


def answers(events: DataFrame) -> DataFrame:
    """Per event a CPU and a memory answer in JSON; error events have no series, signups no memory."""
    number = F.floor(F.col("value")).cast("string")
    empty = F.lit('{"status":"success","data":{"resultType":"vector","result":[]}}')

    def vector(*numbers):
        rows = []
        for n in numbers:
            rows += [F.lit(',{"metric":{},"value":[1704067200,"' if rows else '{"metric":{},"value":[1704067200,"'), n, F.lit('"]}')]
        return F.concat(
            F.lit('{"status":"success","data":{"resultType":"vector","result":['), *rows, F.lit("]}}")
        )

    kind = F.col("event_type")
    k = _k().cast("string")
    return events.select(
        "event_id",
        *_scrape_columns(),
        F.when(kind == "error", empty).otherwise(vector(F.concat(number, F.lit(".75")), k)).alias("cpu_answer"),
        F.when(kind.isin("error", "signup"), empty)
        .when(_k() == 13, vector(F.lit("unknown")))
        .otherwise(vector(k))
        .alias("memory_answer"),
    )


def usage_lines(events: DataFrame) -> DataFrame:
    """Per event one line of a usage dump; its kind decides the units and the missing columns."""
    return events.select(*_scrape_columns(), _usage_line().alias("line"))


def clocked_usage_lines(events: DataFrame) -> DataFrame:
    """The same lines, scraped every ten seconds of the sample clock."""
    timestamp = (F.floor(_clock() / 10) * 10).alias("timestamp")
    return events.select(_strategy().alias("strategy"), timestamp, _usage_line().alias("line"))


def _usage_line():
    kind = F.col("event_type")
    number, k = F.floor(F.col("value")).cast("string"), _k().cast("string")
    pod = F.concat(F.lit("pod-"), F.col("user_id").cast("string"))
    line = (
        F.when(kind == "click", F.concat(pod, F.lit("   "), number, F.lit("m   "), k, F.lit("Mi")))
        .when(kind == "view", F.concat(pod, F.lit(" "), k, F.lit("  "), number, F.lit("Gi ")))
        .when(kind == "purchase", F.concat(F.lit(" "), pod, F.lit("\t"), number, F.lit("m\t"), number, F.lit("Ki")))
        .when(kind == "signup", F.concat(pod, F.lit(" "), number, F.lit("m")))
        .otherwise(pod)
    )
    return line
