"""Run registered queries beside their oracles and report differences.

python -m fixtures.compare [sf] [query ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from emberline.session import tune
from fixtures import checks, oracles


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


# The types each engine gives the same column.
SAME = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
    "decimal(30,0)": "DECIMAL(30,0)",
}


def difference(df, con, sql: str) -> str | None:
    """Why a frame and an SQL result differ, or None. Types must match too."""
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    types = {d[0]: str(d[1]) for d in rel.description}
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    for field in df.schema.fields:
        if SAME[field.dataType.simpleString()] != types[field.name]:
            return f"type of {field.name}: {field.dataType.simpleString()} vs {types[field.name]}"
    order = sorted(names)
    ours = sorted((tuple(row[c] for c in order) for row in df.collect()), key=repr)
    at = [names.index(c) for c in order]
    theirs = sorted((tuple(row[i] for i in at) for row in rel.fetchall()), key=repr)
    if len(ours) != len(theirs):
        return f"rows {len(ours)} vs {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b:
            return f"{order}\n  ours   {a}\n  theirs {b}"
    return None


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def main(argv: list[str]) -> int:
    sf = argv[0] if argv else "/root/testdata/sf0.01"
    spark, con, sql = session(), connect(sf), oracles.sql()
    bad = 0
    for name in argv[1:] or checks.QUERIES:
        start = time.time()
        try:
            df = checks.QUERIES[name](spark, sf)
            why = difference(df, con, sql[name]) if name in sql else f"{df.count()} rows, no oracle"
        except Exception as error:
            why = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += why is not None
        print(f"{'ok  ' if why is None else 'FAIL'} {name} {time.time() - start:.1f}s {why or ''}", flush=True)
    print(f"{bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]) > 0)
