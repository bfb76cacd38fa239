"""The named jobs of the command line: what they read, how heavy they are, what they return."""

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructType

from ledgerline.operators import property as prices
from ledgerline.operators import reviews as games
from ledgerline.schemas import RESULTS
from ledgerline.sinks.files import write_each, write_single, write_table
from ledgerline.sources.files import DataRoot, read_games, read_reviews, read_sales, read_users

LIGHT, HEAVY = "light", "heavy"


@dataclass(frozen=True)
class Job:
    name: str
    weight: str
    inputs: dict
    build: Callable
    shared: Callable | None = None
    results: list = field(default_factory=list)
    sink: Callable = write_single

    @property
    def schemas(self):
        return {name: StructType.fromDDL(RESULTS[name]) for name in self.results or [self.name]}


def _light(name, build, sink=write_single):
    return Job(
        name, LIGHT, {"reviews": read_reviews},
        lambda reviews: {name: build(games.typed_reviews(reviews))}, sink=sink,
    )


REGISTRY = {
    job.name: job
    for job in [
        _light("top_games", games.top_games, sink=write_table),
        _light("sentiment", games.sentiment),
        _light("user_activity", games.user_activity, sink=write_table),
        Job(
            "steam_heavy", HEAVY,
            {"reviews": read_reviews, "games": read_games, "users": read_users},
            lambda reviews, games_, users: {
                "steam_heavy": games.score_games(
                    games.typed_reviews(reviews), games.typed_games(games_), games.typed_users(users)
                )
            },
            sink=write_table,
        ),
        Job(
            "property_prices", HEAVY, {"sales": read_sales}, prices.property_report,
            shared=lambda sales: prices.report_stats(prices.clean_sales(sales)),
            results=["by_county", "by_year", "by_property_type", "affordability_gap"],
        ),
    ]
}
DEFAULT_JOB = "steam_heavy"


def find_job(name: str) -> Job:
    key = name.strip().lower()
    if key not in REGISTRY:
        raise ValueError(f"Unknown job {name!r}; valid names are {', '.join(sorted(REGISTRY))}")
    return REGISTRY[key]


def _check_schema(name: str, df: DataFrame, expected) -> None:
    """Names in order, and the types of what is computed; keys keep the type of the input."""
    found = [(f.name, f.dataType) for f in df.schema]
    wanted = [(f.name, f.dataType) for f in expected]
    same_names = [n for n, _ in found] == [n for n, _ in wanted]
    same_types = all(w == f or w == StringType() for (_, f), (_, w) in zip(found, wanted))
    if not (same_names and same_types):
        raise TypeError(f"{name}: expected {expected.simpleString()}, got {df.schema.simpleString()}")


def run(spark: SparkSession, name: str, root: DataRoot, out=None, partitions=None):
    """Build a job's results and, with ``out``, write them; returns ({result: DataFrame}, seconds).

    A job with several results has a small shared stage, computed once for all its writes.

    ``partitions`` maps an input to a round-robin partition count, for load tests; by default
    Spark sizes the partitions.
    """
    job = find_job(name)
    started = time.perf_counter()
    tables = [read(spark, root) for read in job.inputs.values()]
    for i, input_name in enumerate(job.inputs):
        count = (partitions or {}).get(input_name)
        tables[i] = tables[i].repartition(count) if count else tables[i]
    shared = job.shared(*tables) if job.shared else None
    if shared is not None:
        tables = [shared.persist(StorageLevel.MEMORY_AND_DISK) if out else shared]
    try:
        results = job.build(*tables)
        for result_name, schema in job.schemas.items():
            _check_schema(result_name, results[result_name], schema)
        if out and job.results:
            write_each(results, out, job.sink)
        elif out:
            job.sink(results[job.name], out)
    finally:
        if shared is not None and out:
            shared.unpersist()
    return results, time.perf_counter() - started
