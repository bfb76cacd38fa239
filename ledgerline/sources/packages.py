"""Sends this package to the executors, so that Python functions can import it there."""

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import ledgerline

_sent: set[str] = set()


def send_package(spark: SparkSession) -> None:
    """Add the package's source to the session's files, once per application.

    The archive is written on the driver only; Spark's file server hands it to each executor.
    """
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    home = os.path.dirname(os.path.abspath(ledgerline.__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="ledgerline-"), "ledgerline.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(home):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("ledgerline", os.path.relpath(path, home)))
    context.addPyFile(archive)
    _sent.add(context.applicationId)
