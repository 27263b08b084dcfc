"""Run a registered query and its SQL and compare rows."""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

from catalog.oracles import ORACLES
from catalog.queries import QUERIES
from faultline.session import local_session


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


def rows_by_name(names: list[str], rows: list) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(row[i] for i in order) for row in rows)


def compare(spark, con, sf_dir: str, name: str) -> str | None:
    """None if both agree, else what differs."""
    df = QUERIES[name](spark, sf_dir)
    spark_rows = rows_by_name(df.columns, df.collect())
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    types = {d[0]: str(d[1]) for d in cursor.description}
    kinds = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    odd = [(n, t, types[n]) for n, t in df.dtypes if kinds.get(t) != types[n]]
    sql_rows = rows_by_name(names, cursor.fetchall())
    if spark_rows != sql_rows:
        extra, missing = list((spark_rows - sql_rows)), list((sql_rows - spark_rows))
        key = lambda r: tuple(str(x) for x in r)
        return (
            f"rows {sum(spark_rows.values())} / {sum(sql_rows.values())}, {len(extra)} / {len(missing)} differ\n"
            f"  {sorted(df.columns)}\n  spark {sorted(extra, key=key)[:2]}\n  sql   {sorted(missing, key=key)[:2]}"
        )
    return f"types {odd}" if odd else None


def main() -> int:
    sf_dir, names = sys.argv[1], sys.argv[2:] or sorted(ORACLES)
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, name)
        except Exception as exc:  # noqa: BLE001
            problem = f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += problem is not None
        print(f"{name}: {problem or 'ok'} ({time.time() - start:.1f}s)", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
