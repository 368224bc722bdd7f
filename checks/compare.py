"""Run queries and their SQL on the same tables and compare rows, columns and values."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

from shoptrail.session import build_session


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _kind(value) -> str:
    return type(value).__name__


def differences(spark_df, relation) -> list[str]:
    """What differs between the results, ignoring the order of rows and columns."""
    columns = sorted(spark_df.columns)
    if columns != sorted(relation.columns):
        return [f"columns {columns} != {sorted(relation.columns)}"]
    ours = sorted((tuple(row[c] for c in columns) for row in spark_df.collect()), key=repr)
    picked = ", ".join(f'"{c}"' for c in columns)
    theirs = sorted(relation.project(picked).fetchall(), key=repr)
    if len(ours) != len(theirs):
        return [f"{len(ours)} rows != {len(theirs)}"]
    wrong = [
        f"{a} != {b}"
        for a, b in zip(ours, theirs, strict=True)
        if a != b or [_kind(x) for x in a] != [_kind(x) for x in b]
    ]
    return wrong[:3] + ([f"{len(wrong)} rows differ of {len(ours)}"] if wrong else [])


def main(sf_dir: str, names: list[str]) -> int:
    from checks.oracle import ORACLE_SQL
    from checks.queries import QUERIES

    spark = build_session("compare", "local[8]", {"spark.sql.shuffle.partitions": "8",
                                                  "spark.ui.enabled": "false",
                                                  "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    failed = 0
    for name in names or list(QUERIES):
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            found = differences(df, con.sql(ORACLE_SQL[name]))
            rows = df.count() if names else ""
        except Exception as error:  # report and go on with the next query
            found, rows = [str(error)[:600]], ""
        failed += bool(found)
        print(f"{'FAIL' if found else 'ok':5}{name} {rows} {time.time() - start:.1f}s",
              *found, sep="\n      " if found else " ", flush=True)
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
