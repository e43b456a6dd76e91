"""Registered queries against their DuckDB oracle SQL on the smallest test tables.

The default run checks every query that does not cluster plus the main
clustering ones; ``TRAILSIFT_FULL_ORACLE=1`` checks all of them
(``python tests/check_oracles.py SF_DIR`` does the same from the command line).
"""

import os

import pytest

import __spark_entry__ as E
from trailsift.plans.oracle import SQL
from trailsift.plans.queries import QUERIES
from oracle_harness import compare, duck

QUICK = {
    "audit_events", "envelope_records", "json_missing_vs_null", "time_range", "service_filter",
    "readonly_filter", "scalar_hash32", "scalar_ip_int", "scalar_user_agent_num",
    "scalar_json_length", "scalar_num_keys", "scalar_os", "identity_tuple", "features_encoded",
    "ingest_files", "bad_files", "absent_fields", "timeframes_signature", "timeframes_json", "clusters_json",
    "neighbour_counts", "features_scaled", "minute_counts", "minute_spine", "rolling_density", "error_timeframes",
    "signature_match", "signature_frequency", "dbscan_labels", "timeframes", "timeframe_report",
}
FULL = os.environ.get("TRAILSIFT_FULL_ORACLE") == "1"
NAMES = sorted(n for n in SQL if FULL or n in QUICK)


@pytest.fixture(scope="module")
def con(sf_small):
    return duck(sf_small)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, sf_small, con, name):
    df = E.queries()[name](spark, sf_small)
    ok, msg = compare(df, con, E.oracle_sql()[name])
    assert ok, msg


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["tf_start", "tf_end", "confidence"]
    assert df.count() >= 0
