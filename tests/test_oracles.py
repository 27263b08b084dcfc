"""Registered queries against their SQL; FULL=1 checks every one."""

import os

import pytest

from catalog.compare import compare, connect
from catalog.oracles import ORACLES
from catalog.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
CORE = (
    "read_structured_entries", "route_inputs", "read_verdicts", "parse_lines", "inherit_trace_level",
    "error_group_report", "source_report", "incident_report", "validate_report", "classify_log",
)


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES) if os.environ.get("FULL") else CORE)
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, SF_DIR, name) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
