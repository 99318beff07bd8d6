"""Compare registered queries with their check SQL.

``python -m tests.oracle [folder] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def normalise(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_datetime64_any_dtype(df[c]):
            df[c] = df[c].astype(str)
    rows = [
        tuple("null" if pd.isna(v) else (f"{v + 0.0:.9g}" if isinstance(v, float) else str(v))
              for v in row)
        for row in df.itertuples(index=False)
    ]
    return sorted(rows)


def compare(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty when equal, otherwise what differs first."""
    ours = spark_df.toPandas()
    theirs = con.sql(sql).df()
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} != {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    # Whole numbers must not be doubles on one side only.
    for c in ours.columns:
        pair = (ours[c].dtype.kind, theirs[c].dtype.kind)
        if "f" in pair and pair[0] != pair[1] and not (ours[c].isna().any() or theirs[c].isna().any()):
            return f"types of {c}: {ours[c].dtype} != {theirs[c].dtype}"
    a, b = normalise(ours), normalise(theirs)
    for left, right in zip(a, b):
        if left != right:
            return f"{sum(x != y for x, y in zip(a, b))} rows differ, e.g.\n   {left}\n   {right}"
    return ""


def main() -> None:
    from meterlens.catalog import QUERIES
    from meterlens.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(QUERIES)
    spark = build_session(
        "oracle", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in wanted:
        query, started = QUERIES[name], time.time()
        try:
            df = query.run(spark, folder)
            result = compare(df, con, query.sql) if query.sql else f"rows only: {df.count()}"
        except Exception as error:  # noqa: BLE001
            result = f"ERROR {str(error)[:600]}"
        ok = not result or result.startswith("rows only")
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - started:.1f}s {result}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
