"""The shared folder, and the package on the executors."""

import os
import subprocess
import sys
import zipfile

from ledgerline.sources import packages
from ledgerline.sources.shared import shared_folder, written


ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_new_folder_for_each_use(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    one, two = shared_folder(spark, "x"), shared_folder(spark, "x")
    assert one != two and one.startswith(f"{base}/x-")


class Bare:
    """A session that only knows its warehouse."""

    class conf:
        @staticmethod
        def get(key, default=None):
            return {"spark.sql.warehouse.dir": "hdfs://store/warehouse"}.get(key, default)


def test_warehouse_where_no_folder_is_set():
    assert shared_folder(Bare, "x").startswith("hdfs://store/warehouse/scratch/x-")


def test_written_table_is_computed_once(spark):
    df = written(spark.range(10).selectExpr("id", "cast(null as string) AS empty", "array(id) AS ids"), "test")
    assert df.count() == 10 and df.dtypes == [("id", "bigint"), ("empty", "string"), ("ids", "array<bigint>")]
    assert "Range" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert written(spark.range(0), "test").count() == 0


def test_package_is_sent_once_and_whole(spark, monkeypatch):
    sent = []
    monkeypatch.setattr(spark.sparkContext, "addPyFile", sent.append)
    monkeypatch.setattr(packages, "_sent", set())
    packages.send_package(spark)
    packages.send_package(spark)
    assert len(sent) == 1
    assert {"ledgerline/__init__.py", "ledgerline/sources/packages.py"} <= set(zipfile.ZipFile(sent[0]).namelist())


def test_contract_imports_without_a_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) >= len(e.oracle_sql()) > 50"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
