"""Run registered queries next to their SQL and compare rows, columns and types."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if hasattr(value, "tzinfo") and value.tzinfo is not None:
        return value.replace(tzinfo=None)
    if type(value).__name__ == "Decimal":
        return round(float(value), 8)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


KIND = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP", "date": "DATE", "float": "FLOAT", "timestamp_ntz": "TIMESTAMP",
}


def compare(spark, con, name, function, sql, sf_dir):
    """Problems found, seconds taken by Spark, row count."""
    start = time.time()
    df = function(spark, sf_dir)
    got = df.collect()
    seconds = time.time() - start
    if sql is None:
        return [], seconds, len(got)
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    want = result.fetchall()
    problems = []
    if sorted(columns) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(columns)}"], seconds, len(got)
    for column, kind in df.dtypes:
        if KIND.get(kind, kind.upper()) != types[column].upper().replace(" ", ""):
            problems.append(f"type {column}: {kind} != {types[column]}")
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    if len(a) != len(b):
        problems.append(f"rows {len(a)} != {len(b)}")
    if a != b:
        left, right = set(map(repr, a)), set(map(repr, b))
        problems.append(f"values: {len(left - right)} only in Spark, {len(right - left)} only in SQL")
        problems += [f"  spark {x[:400]}" for x in sorted(left - right)[:2]]
        problems += [f"  sql   {x[:400]}" for x in sorted(right - left)[:2]]
    return problems, seconds, len(got)


def main() -> int:
    from chunkloom.plans import catalog
    from chunkloom.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    catalog.load()
    names = sys.argv[2:] or list(catalog.QUERIES)
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(sf_dir), 0
    for name in names:
        try:
            problems, seconds, n = compare(spark, con, name, catalog.QUERIES[name], catalog.ORACLE.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001
            problems, seconds, n = [f"{type(error).__name__}: {str(error)[:1200]}"], 0.0, -1
        bad += bool(problems)
        mark = "FAIL" if problems else ("ok" if name in catalog.ORACLE else "ok (rows only)")
        print(f"{mark:14} {name:30} {seconds:6.2f}s {n} rows", flush=True)
        for line in problems:
            print("     ", line, flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(main())
