"""Every job as a query over the given tables: name -> (spark, sf_dir) -> DataFrame.

Doubles are rounded so that results do not depend on summation order. Costs and rates keep
more digits than the readings and the node price can produce.
"""

from pyspark.sql import functions as F

from ledgerline.functions.frames import rounded
from ledgerline.operators import property as prices
from ledgerline.operators import builder, quality, reviews, samples, series, usage
from ledgerline.plans.registry import run
from ledgerline.schemas import SALE_COLUMNS, SAMPLE_COLUMNS
from ledgerline.sources import files, tables
from ledgerline.sources.buckets import bucketed
from ledgerline.sources.shared import shared_folder
from ledgerline.streaming import samples as streams


def _reviews_query(build):
    return lambda spark, sf_dir: rounded(build(tables.reviews(spark, sf_dir)))


def _sales_query(build):
    return lambda spark, sf_dir: rounded(build(tables.sales(spark, sf_dir)))


COST_DIGITS = {"simulated_cost_usd": 10, "observed": 10}


def _samples_query(build):
    return lambda spark, sf_dir: rounded(build(tables.samples(tables.events(spark, sf_dir))), 8, **COST_DIGITS)


def _raw_samples_query(build):
    return lambda spark, sf_dir: build(tables.raw_samples(tables.events(spark, sf_dir)))


def _metrics_query(build, digits=6):
    return lambda spark, sf_dir: rounded(build(tables.metrics(tables.events(spark, sf_dir))), digits)


def steam_heavy(spark, sf_dir):
    return rounded(
        reviews.score_games(
            tables.reviews(spark, sf_dir), tables.games(spark, sf_dir), tables.users(spark, sf_dir)
        )
    )


def scored_games_topk(spark, sf_dir):
    return rounded(reviews.scored_games_topk(steam_heavy(spark, sf_dir)))


def scored_games(spark, sf_dir):
    inputs = tables.reviews(spark, sf_dir), tables.games(spark, sf_dir), tables.users(spark, sf_dir)
    return rounded(reviews.scored_games(rounded(reviews.scored_in_any_order(*inputs))))


def bucketed_steam_heavy(spark, sf_dir):
    """The flagship job over reviews and users stored in buckets by user: their join needs no shuffle."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = bucketed(tables.reviews(spark, sf_dir), "user_id", buckets, "reviews")
    known = bucketed(tables.users(spark, sf_dir), "user_id", buckets, "users")
    return rounded(reviews.score_games(stored, tables.games(spark, sf_dir), known))


def kept_property_report(spark, sf_dir):
    """The price tables merged from stored parts of three deliveries of sales."""
    folder = shared_folder(spark, "report")
    sales = tables.sales(spark, sf_dir)
    for batch, years in (("old", F.col("year") < 1995), ("middle", F.col("year").between(1995, 1996)), ("new", F.col("year") > 1996)):
        prices.keep_report(sales.filter(years), folder, batch, sketch_size=4096)
    return rounded(prices.kept_report(spark, folder))


def clean_sales(spark, sf_dir):
    cleaned = prices.clean_sales(tables.raw_sales(spark, sf_dir))
    return cleaned.select("transaction_id", "price", "year", "property_type", "district", "county")


def sample_rejects(raw):
    return quality.split_samples(raw, rules="full")[1]


def _cpu_rates(metrics, window_seconds=60):
    counter = series.select_series(metrics, series.CPU_COUNTER, real_containers=True)
    return series.counter_rate(counter, window_seconds)


def counter_rate(metrics):
    return _cpu_rates(metrics)


def extrapolated_rate(metrics):
    return series.extrapolated_rate(series.select_series(metrics, series.CPU_COUNTER, real_containers=True))


def process_cpu_rate(metrics):
    counter = series.select_series(metrics, series.PROCESS_CPU_COUNTER, pod_prefix="spark-dynamic")
    return series.counter_rate(counter, 30).select("pod", "container", "ts", "rate")


def cpu_millicores(metrics):
    return series.cpu_millicores(_cpu_rates(metrics))


def memory_mib(metrics):
    return series.memory_mib(series.select_series(metrics, series.WORKING_SET, real_containers=True))


def live_count(metrics):
    return series.live_count(series.select_series(metrics, series.UP))


def executor_lifecycle(metrics):
    return series.executor_lifecycle(series.select_series(metrics, series.UP))


def threshold_breaches(metrics):
    readings = series.autoscaler_readings(metrics)
    return series.threshold_breaches(readings, series.thresholds(metrics.sparkSession))


def metric_answers(spark, sf_dir):
    answers = tables.answers(tables.events(spark, sf_dir))
    cpu = usage.metric_answers(answers, "cpu_answer", "cpu_millicores")
    return usage.metric_answers(cpu, "memory_answer", "memory_mib")


def usage_dump(spark, sf_dir):
    lines = tables.usage_lines(tables.events(spark, sf_dir))
    return usage.usage_dump(lines, ["strategy", "timestamp"])


def sample_fallback(spark, sf_dir):
    """One answer per scrape, the first event's. Signups are not answered and errors not dumped, so each side lacks scrapes."""
    keys = ["strategy", "timestamp"]
    events = tables.events(spark, sf_dir)
    answers = tables.answers(events.filter("event_type <> 'signup'"))
    totals = usage.metric_answers(usage.metric_answers(answers, "cpu_answer", "cpu_millicores"), "memory_answer", "memory_mib")
    first = F.min_by(F.struct("cpu_millicores", "memory_mib"), "event_id").alias("first")
    primary = totals.groupBy(*keys).agg(first).select(*keys, "first.*")
    dump = usage.usage_dump(tables.usage_lines(events.filter("event_type <> 'error'")), keys)
    return usage.sample_fallback(primary, dump, keys)


def stream_rollup(spark, sf_dir):
    return rounded(streams.rollup_now(tables.samples(tables.event_stream(spark, sf_dir))), 8, **COST_DIGITS)


def _arriving(spark, sf_dir, slices, delayed, arrived):
    """Write the samples as they arrive and call ``arrived`` with a stream of them and a folder, after each slice."""
    folder = shared_folder(spark, "arriving")
    for part in tables.arrivals(tables.events(spark, sf_dir), slices, delayed):
        newest = tables.samples(part)
        newest.write.mode("append").parquet(f"{folder}/samples")
        stream = spark.readStream.schema(newest.schema).parquet(f"{folder}/samples")
        arrived(stream, folder)
    return stream, folder


def stream_started_samples(spark, sf_dir):
    """The gate over samples that arrive in four slices of time; every slice is a restart from the checkpoint."""

    def arrived(stream, folder):
        gated = streams.started_stream(stream)
        streams.write_stream(gated, f"{folder}/started", f"{folder}/checkpoint").awaitTermination()

    stream, folder = _arriving(spark, sf_dir, 4, 0, arrived)
    return spark.read.schema(stream.schema).parquet(f"{folder}/started")


def stream_closed_minutes(spark, sf_dir):
    """Closed minutes over samples that arrive in four slices of time, each seventh event one slice late."""

    def arrived(stream, folder):
        for query in streams.close_minutes(stream, folder):
            query.awaitTermination()

    stream, folder = _arriving(spark, sf_dir, 4, 7, arrived)
    return rounded(streams.minute_ledger(stream, folder), 8, **COST_DIGITS)


def numbered_rejects(spark, sf_dir):
    """The bad rows of results files, with their row in the file; a file for each day is written first, in the order of events."""
    folder = shared_folder(spark, "results")
    day = F.concat(F.substring("file", 1, 8), F.lit("-000000-steam_heavy.csv"))
    raw = tables.raw_samples(tables.events(spark, sf_dir)).withColumn("file", day)
    raw = raw.repartition("file").sortWithinPartitions("file", "event_id")
    keep_spaces = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    raw.select("file", *SAMPLE_COLUMNS).write.partitionBy("file").csv(folder, header=True, **keep_spaces)
    _, rejects = files.read_samples(spark, folder, strict=False, rules="full")
    return rejects.select(F.regexp_extract("path", "/file=([^/]+)/", 1).alias("file"), "row", *SAMPLE_COLUMNS, "reasons")


def csv_steam_heavy(spark, sf_dir):
    """The flagship job over headed CSV files of the three tables."""
    root = files.DataRoot(shared_folder(spark, "games"))
    for name, source in (("recommendations", tables.reviews), ("games", tables.games), ("users", tables.users)):
        source(spark, sf_dir).write.csv(root.table("games", name), header=True)
    return rounded(run(spark, "steam_heavy", root)[0]["steam_heavy"])


def csv_property_report(spark, sf_dir):
    """The four report tables as written to CSV, from a headerless file of 16 fields with bad and quoted ones; read back as text."""
    root = files.DataRoot(shared_folder(spark, "prices"))
    raw = tables.raw_sales(spark, sf_dir)
    known = {name: F.col(name) for name in raw.columns} | {"street": F.lit('1, "Mill" Lane'), "saon": F.lit("")}
    fields = [known.get(name, F.lit(None).cast("string")).alias(name) for name in SALE_COLUMNS]
    raw.select(*fields).write.csv(root.table("input", "land-data"), escape='"', emptyValue="")
    run(spark, "property_prices", root, out=root.output("report"))
    report = {
        "by_county": ["county"], "by_year": ["year"], "by_property_type": ["property_type"], "affordability_gap": ["district", "county"]
    }
    found = None
    for name, keys in report.items():
        table = spark.read.csv(root.output("report", name), header=True)
        total = F.col("count" if name == "by_property_type" else "total_sales")
        part = table.select(F.lit(name).alias("report"), F.concat_ws("/", *keys).alias("key"), total.alias("total_sales"), "median_price")
        found = part if found is None else found.unionByName(part)
    return found


def built_samples(spark, sf_dir):
    rows = tables.events(spark, sf_dir)
    dump = usage.usage_dump(tables.clocked_usage_lines(rows), ["strategy", "timestamp"])
    return builder.metrics_to_samples(tables.metrics(rows), dump, "built")


def built_cost_summary(spark, sf_dir):
    return rounded(samples.cost_summary(built_samples(spark, sf_dir)), 8, **COST_DIGITS)


def stream_ingest(spark, sf_dir):
    good, rejects = streams.ingest_now(tables.raw_samples(tables.event_stream(spark, sf_dir)))
    shape = ["event_id", "file", "strategy", "timestamp", "executor_count", "cpu_millicores", "memory_mib"]
    typed = good.select(*shape, F.lit("").alias("reasons"))
    none = {name: F.lit(None).cast(dtype) for name, dtype in typed.dtypes if name in shape[2:]}
    return typed.unionByName(rejects.withColumns(none).select(*typed.columns))


QUERIES = {
    "steam_heavy": steam_heavy,
    "top_games": _reviews_query(reviews.top_games),
    "sentiment": _reviews_query(reviews.sentiment),
    "user_activity": _reviews_query(reviews.user_activity),
    "rank_in_library": lambda spark, sf_dir: reviews.rank_in_library(tables.reviews(spark, sf_dir)),
    "top_games_contract": _reviews_query(lambda df: reviews.top_games(df, "recommendation_count")),
    "app_sentiment": _reviews_query(reviews.app_sentiment),
    "sentiment_ratio": _reviews_query(reviews.sentiment_ratio),
    "most_active_users": _reviews_query(reviews.most_active_users),
    "top_games_topk": _reviews_query(reviews.top_games_topk),
    "most_active_users_topk": _reviews_query(reviews.most_active_users_topk),
    "scored_games": scored_games,
    "scored_games_topk": scored_games_topk,
    "clean_sales": clean_sales,
    "by_county": _sales_query(prices.by_county),
    "by_year": _sales_query(prices.by_year),
    "by_property_type": _sales_query(prices.by_property_type),
    "affordability_gap": _sales_query(prices.affordability_gap),
    "property_report": _sales_query(prices.report_stats),
    "by_county_exact": _sales_query(lambda df: prices.by_county(df, exact=True)),
    "by_year_exact": _sales_query(lambda df: prices.by_year(df, exact=True)),
    "by_property_type_exact": _sales_query(lambda df: prices.by_property_type(df, exact=True)),
    "affordability_gap_exact": _sales_query(lambda df: prices.affordability_gap(df, exact=True)),
    "county_contract": _sales_query(prices.county_contract),
    "yoy_trend": _sales_query(prices.yoy_trend),
    "started_samples": _samples_query(samples.started_samples),
    "cost_summary": _samples_query(samples.cost_summary),
    "compare_strategies": _samples_query(samples.compare_strategies),
    "metric_winners": _samples_query(lambda df: samples.metric_winners(samples.cost_summary(df))),
    "run_superlatives": _samples_query(lambda df: samples.run_superlatives(samples.cost_summary(df))),
    "dead_metrics": _samples_query(samples.dead_metrics),
    "minute_rollup": _samples_query(samples.minute_rollup),
    "sample_rejects": _raw_samples_query(sample_rejects),
    "clean_samples": _raw_samples_query(lambda df: quality.split_samples(df)[0]),
    "reading_warnings": _raw_samples_query(quality.reading_warnings),
    "complete_runs": _raw_samples_query(quality.complete_runs),
    "newest_complete_run": _raw_samples_query(quality.newest_complete_run),
    "run_checks": _samples_query(quality.run_checks),
    "counter_rate": _metrics_query(counter_rate, 9),
    "extrapolated_rate": _metrics_query(extrapolated_rate, 9),
    "process_cpu_rate": _metrics_query(process_cpu_rate, 9),
    "cpu_millicores": _metrics_query(cpu_millicores),
    "memory_mib": _metrics_query(memory_mib),
    "heap_pct": _metrics_query(series.heap_pct),
    "heap_pct_by_strategy": _metrics_query(series.heap_pct_by_strategy),
    "heap_bytes": _metrics_query(series.heap_bytes),
    "live_count": _metrics_query(live_count),
    "executor_lifecycle": _metrics_query(executor_lifecycle),
    "threshold_breaches": _metrics_query(threshold_breaches),
    "metric_presence": _metrics_query(series.metric_presence),
    "metric_answers": metric_answers,
    "usage_dump": usage_dump,
    "sample_fallback": sample_fallback,
    "built_samples": built_samples,
    "built_cost_summary": built_cost_summary,
    "stream_rollup": stream_rollup,
    "stream_ingest": stream_ingest,
    "stream_started_samples": stream_started_samples,
    "stream_closed_minutes": stream_closed_minutes,
    "numbered_rejects": numbered_rejects,
    "csv_steam_heavy": csv_steam_heavy,
    "bucketed_steam_heavy": bucketed_steam_heavy,
    "kept_property_report": kept_property_report,
    "csv_property_report": csv_property_report,
}
