"""Run a query and its SQL on the same tables and describe the difference."""

import datetime
import decimal
import glob
import os

import duckdb


def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float) and value == 0:
        return 0.0
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shaped = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(shaped, key=lambda row: [(v is None, str(v)) for v in row])


def differences(spark_df, con, sql):
    found = _rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cursor = con.execute(sql)
    wanted = _rows([d[0] for d in cursor.description], cursor.fetchall())
    if found[0] != wanted[0]:
        return f"columns {found[0]} != {wanted[0]}"
    if len(found[1]) != len(wanted[1]):
        return f"{len(found[1])} rows != {len(wanted[1])}"
    bad = [(a, b) for a, b in zip(found[1], wanted[1]) if a != b]
    return f"{len(bad)} of {len(found[1])} rows differ, e.g. {bad[0]}" if bad else None
