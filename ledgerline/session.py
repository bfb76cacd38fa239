"""Session for the command line, the benchmark and the tests.

Library code never touches the session; everything here is left to the caller on a cluster.
"""

from pyspark.sql import SparkSession


def build_session(app_name="ledgerline", master=None, **conf):
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
