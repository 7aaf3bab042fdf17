"""Compare registered queries with their SQL on DuckDB."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(v):
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}" if v != 0 else "0"
    if isinstance(v, int):
        return f"{float(v):.9g}" if v else "0"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


def normalised(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, fn, sql):
    """None when equal, otherwise a description of the first differences."""
    df = fn(spark, sf_dir)
    got_cols, got = normalised(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols, want = normalised([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if got != want:
        a, b = set(got), set(want)
        return f"rows {len(got)} vs {len(want)}; only here {sorted(a - b)[:3]}; only SQL {sorted(b - a)[:3]}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as E
    from biosieve.session import get_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = get_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles = E.oracle_sql()
    bad = 0
    for name, fn in E.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            result = compare(spark, con, sf_dir, fn, oracles[name]) if name in oracles else f"rows only: {fn(spark, sf_dir).count()}"
        except Exception as error:  # report and go on with the other queries
            result = f"{type(error).__name__}: {str(error).splitlines()[0][:300]}"
        bad += bool(result)
        print(f"{'ok ' if not result else 'BAD'} {name} {time.time() - start:.2f}s {result or ''}", flush=True)
    print("failures:", bad)
