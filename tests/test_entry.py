"""The driver contract: names agree, and a few registered queries run."""

import pytest

import __spark_entry__ as entry
from workload import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["pair_check_summary", "audit_events_once", "scan_geopackages", "sheet_status"])
def test_query_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
