"""FLT-1..3 edge cases, including the reference's odd start times and service lists."""

import datetime as dt

import pytest

from trailsift.operators.filters import filter_by_services, filter_by_time, filter_readonly


@pytest.fixture(scope="module")
def events(spark):
    rows = [
        (1, dt.datetime(2020, 9, 25, 12, 0, 0), "s3.amazonaws.com", "true"),
        (2, dt.datetime(2020, 9, 25, 12, 1, 0), "ec2.amazonaws.com", "True"),
        (3, dt.datetime(2020, 9, 25, 12, 2, 0), "iam.amazonaws.com", "false"),
        (4, None, None, None),
        (5, dt.datetime(2020, 9, 25, 12, 5, 0), "ec2", "y"),
    ]
    return spark.createDataFrame(rows, "event_id LONG, eventTime TIMESTAMP_NTZ, "
                                       "eventSource STRING, readOnly STRING")


def ids(df):
    return sorted(r.event_id for r in df.select("event_id").collect())


def test_time_bounds_inclusive(events):
    out = filter_by_time(events, "2020-09-25T12:01:00Z", "2020-09-25T12:02:00Z")
    assert ids(out) == [2, 3]


def test_time_only_start_and_zone(events):
    assert ids(filter_by_time(events, "2020-09-25T14:01:00+02:00", None)) == [2, 3, 5]


@pytest.mark.parametrize("bad", ["invalid-time", "2020-13-45T25:70:99Z", "not-a-date"])
def test_bad_bound_drops_whole_filter(events, bad):
    assert ids(filter_by_time(events, bad, "2020-09-25T12:00:00Z")) == [1, 2, 3, 4, 5]
    assert ids(filter_by_time(events, "2020-09-25T12:01:00Z", bad)) == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("start", ["2020/09/25 12:02", "25 Sep 2020 12:02", "Sep 25, 2020 12:02:00", "2020-9-25 12:02"])
def test_other_forms_of_bounds(events, start):
    assert ids(filter_by_time(events, start, None)) == [3, 5]


@pytest.mark.parametrize("empty", ["", None])
def test_empty_bounds_mean_no_filter(events, empty):
    assert ids(filter_by_time(events, empty, empty)) == [1, 2, 3, 4, 5]


def test_services(events):
    assert ids(filter_by_services(events, ["ec2"])) == [2, 5]
    assert ids(filter_by_services(events, ["ec2", ""])) == [2, 5]
    assert ids(filter_by_services(events, [""])) == []
    assert ids(filter_by_services(events, ["invalid-api"])) == []
    assert ids(filter_by_services(events, [None])) == []
    assert ids(filter_by_services(events, [])) == [1, 2, 3, 4, 5]
    assert ids(filter_by_services(events, None)) == [1, 2, 3, 4, 5]


def test_readonly(events, spark):
    assert ids(filter_readonly(events)) == [1, 2, 5]
    booleans = spark.createDataFrame([(1, True), (2, False), (3, None)], "event_id LONG, readOnly BOOLEAN")
    assert ids(filter_readonly(booleans)) == [1]
    assert ids(filter_readonly(events.drop("readOnly"))) == [1, 2, 3, 4, 5]


def test_landed_table_prunes_date_partitions(spark, tmp_path):
    from trailsift.sources.ingest import land_as_parquet, read_landed
    from trailsift.sources.schema import AUDIT_COLUMNS
    from pyspark.sql import functions as F
    rows = [(i, dt.datetime(2024, 1, 1 + i % 5, 12, 0)) for i in range(20)]
    base = spark.createDataFrame(rows, "event_id LONG, eventTime TIMESTAMP")
    full = base.select(*[F.col(c) if c in base.columns else F.lit(None).cast("string").alias(c)
                         for c in AUDIT_COLUMNS])
    land_as_parquet(full, str(tmp_path / "landed"))
    landed = read_landed(spark, str(tmp_path / "landed"))
    out = filter_by_time(landed, "2024-01-02T00:00:00Z", "2024-01-03T23:59:59Z")
    assert sorted(r.event_id for r in out.collect()) == [i for i in range(20) if i % 5 in (1, 2)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
