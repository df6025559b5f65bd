"""Run registered queries beside their SQL in DuckDB and compare rows without regard to order.

``python tests/compare.py [sf_dir] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def _text(value) -> str:
    if value is None or (isinstance(value, float) and value != value) or value is pd.NaT:
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if hasattr(value, "tolist") and not isinstance(value, str):
        value = value.tolist()
    if isinstance(value, float):
        return repr(value)
    if isinstance(value, list | tuple):
        return "[" + ",".join(_text(v) for v in value) + "]"
    return str(value)


def rows_of(columns, rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_text(row[i]) for i in order) for row in rows)


def compare(spark, con, sf_dir: str, name: str) -> str:
    from __spark_entry__ import oracle_sql, queries

    df = queries()[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(row) for row in df.collect()])
    sql = oracle_sql().get(name)
    if sql is None:
        return f"ROWS {len(got)}"
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    want = rows_of(columns, result.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"COLUMNS {sorted(df.columns)} != {sorted(columns)}"
    if len(got) != len(want):
        return f"COUNT {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    return f"DIFF {len(bad)}/{len(got)} {bad[0]}" if bad else f"OK {len(got)}"


def local_session():
    from quantloom.session import build_session

    spark = build_session(
        "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    from __spark_entry__ import queries

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(queries())
    spark, con = local_session(), connect(sf_dir)
    for name in names:
        start = time.time()
        try:
            line = compare(spark, con, sf_dir, name)
        except Exception as e:  # noqa: BLE001
            line = f"ERROR {type(e).__name__} {str(e)[:700]}"
        print(f"{name:28s} {time.time() - start:6.1f}s {line[:900]}", flush=True)


if __name__ == "__main__":
    main()
