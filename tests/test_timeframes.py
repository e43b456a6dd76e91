"""Timeframe detection (ML-5/6, WIN-1..5) against a dense pandas statement of the definition."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trailsift.operators import timeframes as T


def dense_reference(times, flags, window=60, threshold=0.10):
    """Per-minute counts on a full minute index, trailing sums, density, runs."""
    df = pd.DataFrame({"t": pd.to_datetime(times), "s": flags}).dropna()
    df["m"] = df["t"].dt.floor("min")
    idx = pd.date_range(df["m"].min(), df["m"].max(), freq="min")
    total = df.groupby("m").size().reindex(idx, fill_value=0)
    susp = df[df["s"]].groupby("m").size().reindex(idx, fill_value=0)
    rt = total.rolling(window, min_periods=1).sum()
    rs = susp.rolling(window, min_periods=1).sum()
    dens = (rs / rt).fillna(0.0)
    out, start = [], None
    for ts, d in dens.items():
        if d >= threshold and start is None:
            start = ts
        elif d < threshold and start is not None:
            out.append((start, ts, dens[start:ts].max()))
            start = None
    if start is not None:
        out.append((start, idx[-1], dens[start:].max()))
    return [(a.to_pydatetime(), b.to_pydatetime(), round(float(c), 9)) for a, b, c in out]


def _events(spark, times, flags):
    rows = [(i, t, "Api", f) for i, (t, f) in enumerate(zip(times, flags))]
    return spark.createDataFrame(rows, "event_id LONG, eventTime TIMESTAMP_NTZ, eventName STRING, "
                                       "flag BOOLEAN")


def _spark_tfs(spark, times, flags, window=60, threshold=0.10):
    tfs = T.detect_timeframes(_events(spark, times, flags), "flag", window, threshold)
    return sorted((r.tf_start, r.tf_end, round(r.confidence, 9)) for r in tfs.collect())


@pytest.mark.parametrize("seed,window,threshold", [(1, 60, 0.10), (2, 5, 0.40), (3, 60, 0.5),
                                                  (4, 15, 0.25)])
def test_sparse_equals_dense(spark, seed, window, threshold):
    rng = np.random.default_rng(seed)
    base = dt.datetime(2024, 1, 1)
    n = 400
    minutes = np.sort(rng.integers(0, 3 * 24 * 60, n))
    times = [base + dt.timedelta(minutes=int(m), seconds=int(s))
             for m, s in zip(minutes, rng.integers(0, 60, n))]
    flags = [bool(x) for x in rng.random(n) < 0.15]
    assert _spark_tfs(spark, times, flags, window, threshold) == \
        dense_reference(times, flags, window, threshold)


def test_open_last_timeframe_and_threshold_equality(spark):
    base = dt.datetime(2024, 1, 1, 10, 0)
    times = [base + dt.timedelta(minutes=m) for m in (0, 1, 2, 3, 4, 30, 31)]
    flags = [False] * 4 + [False, True, True]
    # at 10:30 density = 1/6; still flagged through the last minute 10:31 -> run is open
    got = _spark_tfs(spark, times, flags, 60, 1 / 6)
    assert got == dense_reference(times, flags, 60, 1 / 6)
    assert got[-1][1] == dt.datetime(2024, 1, 1, 10, 31)


def test_no_suspicious_events(spark):
    base = dt.datetime(2024, 1, 1)
    times = [base + dt.timedelta(minutes=m) for m in range(10)]
    assert _spark_tfs(spark, times, [False] * 10) == []


def test_empty_events(spark):
    empty = spark.createDataFrame([], "event_id LONG, eventTime TIMESTAMP_NTZ, eventName STRING, "
                                      "flag BOOLEAN")
    assert T.detect_timeframes(empty, "flag").count() == 0


def test_interval_join_and_identities(spark):
    base = dt.datetime(2024, 1, 1, 9, 0)
    rows = [(1, base, "GetUser", '{"type":"IAMUser","arn":"arn:a"}', "1.2.3.4", "aws-cli/2 Linux"),
            (2, base + dt.timedelta(minutes=1, seconds=30), "ListRoles",
             '{"type":"Root","principalId":"P"}', "5.6.7.8", "[Boto3/1 Windows]"),
            (3, base + dt.timedelta(hours=2, minutes=5), "GetUser", "{}", "h", "x")]
    susp = spark.createDataFrame(rows, "event_id LONG, eventTime TIMESTAMP_NTZ, eventName STRING, "
                                       "userIdentity STRING, sourceIPAddress STRING, userAgent STRING")
    tfs = spark.createDataFrame([(base, base + dt.timedelta(minutes=2), 0.5)],
                                "tf_start TIMESTAMP_NTZ, tf_end TIMESTAMP_NTZ, confidence DOUBLE")
    ev = T.timeframe_events(tfs, susp)
    ids = T.timeframe_identities(ev).orderBy("ord").collect()
    assert [(r.ip, r.iam, r.os) for r in ids] == [("1.2.3.4", "arn:a", "Linux"),
                                                  ("5.6.7.8", "P", "Windows")]
    apis = T.timeframe_apis(ev).first()
    assert apis.example_apis == ["GetUser", "ListRoles"] and apis.n_identities == 2
    rep = T.timeframe_report(tfs, ev).first()
    assert rep.duration_seconds == 120 and rep.apis_shown == "Other: GetUser, ListRoles"
    assert rep.identities_shown.split(" || ")[1] == "5.6.7.8 / P / Boto3/1 Windows / Windows"


def test_hour_with_most_events_is_no_single_task(spark):
    base = dt.datetime(2024, 1, 1, 9, 0)
    ev = spark.range(10_000).select(
        F.col("id").alias("event_id"), F.when(F.col("id") < 9000, F.lit(base)).otherwise(
            F.lit(base + dt.timedelta(hours=3))).cast("timestamp_ntz").alias("eventTime"))
    tfs = spark.createDataFrame([(base, base + dt.timedelta(minutes=2), 0.5),
                                 (base + dt.timedelta(hours=1), base + dt.timedelta(hours=4), 0.6)],
                                "tf_start TIMESTAMP_NTZ, tf_end TIMESTAMP_NTZ, confidence DOUBLE")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:  # the plan as it is without run-time help
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        tasks = T.timeframe_events(tfs, ev).groupBy(F.spark_partition_id().alias("task"), "tf_start").agg(
            F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("events")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(r.n for r in tasks) == sum(r.events for r in tasks) == 10_000
    assert max(r.n for r in tasks if r.tf_start == base) < 5000


def test_first_identities_skewed_timeframe(spark):
    df = spark.range(0, 5000).select(F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz")
                                     .alias("tf_start"), F.col("id").alias("ord"))
    got = T.first_identities(df, 5).orderBy("pos").collect()
    assert [r.ord for r in got] == [0, 1, 2, 3, 4]


def _islands(spark, minutes, partitions=3):
    base = dt.datetime(1970, 1, 3)
    rows = [(base + dt.timedelta(minutes=m), 0.5 + m % 7 / 100) for m in minutes]
    density = spark.createDataFrame(rows, "minute timestamp_ntz, density double").repartition(partitions)
    found = T.islands(density, 0.4, F.lit("9999-01-01 00:00:00").cast("timestamp_ntz"))
    assert "SinglePartition" not in found._jdf.queryExecution().executedPlan().toString()
    return sorted((round((r.tf_start - base).total_seconds() / 60), round((r.tf_end - base).total_seconds() / 60),
                   r.confidence) for r in found.collect())


def test_islands_over_days(spark):
    day = 1440
    runs = [(-4 * day - 5, -3 * day + 1), (3, 9), (11, 11), (day - 1, day - 1), (day + 1, 4 * day - 1), (5 * day, 5 * day),
            (6 * day - 2, 6 * day - 1), (6 * day + 1, 6 * day + 2), (8 * day - 3, 8 * day + 3)]
    minutes = [m for a, b in runs for m in range(a, b + 1)]
    assert _islands(spark, minutes) == [
        (a, b + 1, max(0.5 + m % 7 / 100 for m in range(a, b + 1))) for a, b in runs]


def test_islands_across_three_partitions(spark):
    assert _islands(spark, range(100, 100 + 3 * 1440)) == [(100, 100 + 3 * 1440, 0.56)]
    assert _islands(spark, []) == []
