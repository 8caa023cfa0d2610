"""Runs checks in Spark and DuckDB and compares the rows. ``python tests/compare.py [names]``"""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def norm(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (int,)):
        return float(value)
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    if isinstance(value, dict):
        return tuple(norm(v) for v in value.values())
    return norm(float(value)) if hasattr(value, "as_tuple") else str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def compare(spark, con, folder, name, query, sql):
    """None when equal, else what differs."""
    df = query(spark, folder)
    mine = rows_of(df.columns, df.collect())
    if sql is None:
        return None if mine else "no rows"
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    theirs = rows_of(columns, result.fetchall())
    if mine == theirs:
        return None
    extra = [r for r in mine if r not in set(theirs)][:3]
    missing = [r for r in theirs if r not in set(mine)][:3]
    return f"{len(mine)} rows != {len(theirs)}; only spark {extra}; only sql {missing}"


def main():
    import __spark_entry__ as entry
    from placegauge.session import build_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session(
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[1:] or list(queries)
    bad = 0
    for name in wanted:
        began = time.time()
        try:
            problem = compare(spark, con, folder, name, queries[name], oracles.get(name))
        except Exception as exc:  # noqa: BLE001 - report and go on with the next check
            problem = f"{type(exc).__name__}: {str(exc)[:300]}"
        bad += problem is not None
        state = "ok" if problem is None else f"FAIL {problem}"
        print(f"{name}: {time.time() - began:.1f}s {state}", flush=True)
    print(f"{len(wanted) - bad}/{len(wanted)} ok")


if __name__ == "__main__":
    main()
