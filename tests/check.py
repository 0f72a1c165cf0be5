"""Run queries against their SQL checks: python tests/check.py [folder] [name prefix ...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

import __spark_entry__ as spark_entry  # noqa: E402
from lexigrain.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return db


def _cell(v):
    if isinstance(v, float):
        return ("nan" if math.isnan(v) else repr(v + 0.0))
    return str(v)


SPARK_KIND = {T.LongType: "BIGINT", T.IntegerType: "INTEGER", T.DoubleType: "DOUBLE",
              T.StringType: "VARCHAR", T.FloatType: "FLOAT", T.BooleanType: "BOOLEAN"}


def compare(spark, db, name: str, folder: str) -> str | None:
    """None when rows, column names, types and values agree, else what differs."""
    df = spark_entry.queries()[name](spark, folder)
    sql = spark_entry.oracle_sql().get(name)
    cols = sorted(df.columns)
    got = sorted(tuple(_cell(r[c]) for c in cols) for r in df.select(*cols).collect())
    if sql is None:
        return None if got else "no rows"
    rel = db.sql(sql)
    if sorted(rel.columns) != cols:
        return f"columns {cols} against {sorted(rel.columns)}"
    kinds = dict(zip(rel.columns, map(str, rel.types)))
    for f in df.schema:
        kind = SPARK_KIND.get(type(f.dataType), f.dataType.simpleString())
        if kind != kinds[f.name]:
            return f"type of {f.name}: {kind} against {kinds[f.name]}"
    at = [rel.columns.index(c) for c in cols]
    want = sorted(tuple(_cell(r[i]) for i in at) for r in rel.fetchall())
    if got != want:
        gone = sorted(set(want) - set(got))[:3]
        extra = sorted(set(got) - set(want))[:3]
        return f"{len(got)} rows against {len(want)}; {cols}; extra {extra}; missing {gone}"
    return None


def main() -> int:
    folder = "/root/testdata/sf0.01"
    names = sys.argv[1:]
    if names and names[0].startswith("/"):
        folder, names = names[0], names[1:]
    spark = local_session()
    db = database(folder)
    bad = 0
    for q in spark_entry.queries():
        if names and not any(q.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            problem = compare(spark, db, q, folder)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        kind = "sql " if q in spark_entry.oracle_sql() else "rows"
        print(f"{kind} {q:40s} {time.time() - start:6.2f}s {'ok' if not problem else problem[:1500]}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
