"""Run registered queries next to their SQL in DuckDB and compare the rows.

    python tools/check_oracle.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return repr(round(value, 9) + 0.0)
    if isinstance(value, int):
        return value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return str(value)


def row_counts(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


KINDS = {"BIGINT": "int", "INTEGER": "int", "HUGEINT": "huge", "SMALLINT": "int", "DOUBLE": "float", "FLOAT": "float",
         "VARCHAR": "str", "BOOLEAN": "bool", "TIMESTAMP": "time", "DATE": "date"}
SPARK_KINDS = {"bigint": "int", "int": "int", "smallint": "int", "double": "float", "float": "float", "string": "str",
               "boolean": "bool", "timestamp_ntz": "time", "timestamp": "time", "date": "date"}


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    result = con.execute(sql)
    sql_columns = [c[0] for c in result.description]
    sql_kinds = {c[0]: KINDS.get(str(c[1]), str(c[1])) for c in result.description}
    expected = row_counts(sql_columns, result.fetchall())
    if sorted(df.columns) != sorted(sql_columns):
        return f"columns {sorted(df.columns)} != {sorted(sql_columns)}"
    for name, kind in df.dtypes:
        if SPARK_KINDS.get(kind, kind) != sql_kinds[name]:
            return f"type of {name}: {kind} != {sql_kinds[name]}"
    got = row_counts(df.columns, [tuple(r) for r in df.collect()])
    if got != expected:
        extra, missing = list((got - expected).items())[:2], list((expected - got).items())[:2]
        return f"rows {sum(got.values())} != {sum(expected.values())}\n    only spark {str(extra)[:900]}\n    only sql   {str(missing)[:900]}"
    return None


def main() -> None:
    from gradeloom.plans.catalog import ALL
    from gradeloom.session import build_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                  "spark.driver.memory": "12g", "spark.driver.host": "localhost"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in args or ALL:
        fn, sql = ALL[name]
        start = time.time()
        try:
            if sql:
                problem = compare(fn(spark, sf_dir), con, sql)
                verdict = "ok" if problem is None else f"DIFF {problem}"
            else:
                verdict = f"rows {fn(spark, sf_dir).count()}"
        except Exception as exc:
            verdict = f"FAIL {type(exc).__name__} {str(exc)[:700]}"
        bad += verdict.startswith(("DIFF", "FAIL"))
        print(f"{name:32s} {time.time() - start:6.2f}s {verdict}", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main()
