"""Registered queries against their SQL over whole tables."""

from pathlib import Path

import duckdb
import pytest

pytest.importorskip("faultline.llm")

from faultline.llm.queries import ORACLES, QUERIES  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for path in sorted(Path(SF_DIR).glob("*.parquet")):
        connection.execute(f"create view {path.stem} as select * from '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    found = QUERIES[name](spark, SF_DIR)
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(found.columns)
    assert sorted(map(str, (tuple(r) for r in found.select(*names).collect()))) == sorted(map(str, cursor.fetchall()))
