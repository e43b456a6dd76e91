"""Streaming density and timeframes equal the batch ones on the minutes and runs they have closed."""

import os
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trailsift.operators import timeframes as T
from trailsift.operators.filters import filter_readonly
from trailsift.sources.adapter import audit_events
from trailsift.streaming import streaming_density, streaming_timeframes


def test_streaming_matches_batch(spark, sf_small):
    ro = filter_readonly(audit_events(spark, sf_small)).select(
        F.col("eventTime").cast("timestamp").alias("eventTime"), "eventName",
        F.col("errorCode").isNotNull().alias("flag"))
    folder = tempfile.mkdtemp(prefix="trailsift-stream-")
    src = os.path.join(folder, "src")
    ro.withColumn("day", F.to_date("eventTime")).write.partitionBy("day").parquet(src)

    stream = spark.readStream.schema("eventTime TIMESTAMP, eventName STRING, flag BOOLEAN") \
        .parquet(os.path.join(src, "*"))
    query = (streaming_density(stream, "flag", 60, watermark="0 seconds")
             .writeStream.outputMode("append").format("memory").queryName("dens_test")
             .option("checkpointLocation", os.path.join(folder, "ckpt"))
             .trigger(availableNow=True).start())
    query.awaitTermination(300)
    got = spark.table("dens_test")

    minutes = T.minute_counts(ro, "flag")
    batch = T.rolling_density(minutes, 60, T.last_minute_literal(minutes))
    closed = got.agg(F.max("minute")).first()[0]
    want = {(r.minute, r.roll_total, r.roll_susp) for r in
            batch.filter(F.col("minute").cast("timestamp") <= F.lit(closed)).collect()}
    have = {(r.minute, r.roll_total, r.roll_susp) for r in got.collect()}
    have = {(m.replace(tzinfo=None), a, b) for m, a, b in have}
    want = {(m.replace(tzinfo=None), a, b) for m, a, b in want}
    assert len(want) > 100
    assert have >= want
    assert {h for h in have if h[0] <= closed.replace(tzinfo=None)} - want == set()


T0 = datetime(2024, 3, 1, 23, 0)
KIND = "eventTime TIMESTAMP, eventName STRING, flag BOOLEAN, account STRING"


def _at(minute, flag, account="a", second=5):
    return T0 + timedelta(minutes=minute, seconds=second), "Call", flag, account


def _stream(spark, batches, **options):
    """The frames of ``batches`` as one micro-batch each, in order."""
    folder = tempfile.mkdtemp(prefix="trailsift-stream-")
    rows = []
    for batch in batches:
        spark.createDataFrame(batch, KIND).coalesce(1).write.mode("append").parquet(f"{folder}/src")
        query = (streaming_timeframes(spark.readStream.schema(KIND).parquet(f"{folder}/src"), "flag", **options)
                 .writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out")
                 .option("checkpointLocation", f"{folder}/ckpt").trigger(availableNow=True).start())
        query.awaitTermination(300)
        assert query.exception() is None
        rows.append(spark.read.parquet(f"{folder}/out").collect() if any(
            f.startswith("part-") for f in os.listdir(f"{folder}/out")) else [])
    return rows


def _batch(spark, rows, window, threshold):
    df = spark.createDataFrame(rows, KIND)
    return {(r.tf_start, r.tf_end, round(r.confidence, 9)) for r in
            T.detect_timeframes(df, "flag", window, threshold).collect()}


def test_timeframes_close_across_batches_and_midnight(spark):
    # Two runs, the first over midnight and over two batches; the last one is open at the end.
    first = [_at(m, 50 <= m) for m in range(0, 70)]
    second = [_at(m, m < 75) for m in range(70, 200)]
    third = [_at(m, 210 <= m < 220 or m > 390) for m in range(200, 400)]
    out = _stream(spark, [first, second, third], window_minutes=5, density_threshold=0.5, watermark="0 seconds")
    have = [{(r.tf_start, r.tf_end, round(r.confidence, 9)) for r in rows} for rows in out]
    want = _batch(spark, first + second + third, 5, 0.5)
    still_open = max(want)
    assert len(want) == 3
    assert have[0] == set() and len(have[1]) == 1 and have[2] == want - {still_open}
    assert len(out[2]) == 2                                        # each once


def test_timeframes_late_rows(spark):
    first = [_at(m, 20 <= m < 30) for m in range(0, 120)]
    # Within the watermark of 30 minutes: counted. Beyond it: dropped, no second timeframe for closed minutes.
    late = [_at(m, True, second=30) for m in range(95, 105)]
    dropped = [_at(m, True, second=40) for m in range(40, 50)]
    last = [_at(m, False) for m in range(120, 300)]
    out = _stream(spark, [first, late + dropped, last], window_minutes=5, density_threshold=0.5,
                  watermark="30 minutes")
    have = {(r.tf_start, r.tf_end, round(r.confidence, 9)) for r in out[-1]}
    assert have == _batch(spark, first + late + last, 5, 0.5)
    assert have != _batch(spark, first + late + dropped + last, 5, 0.5)


def test_timeframes_by_key_and_bad_threshold(spark):
    rows = [_at(m, 10 <= m < 20, "a") for m in range(100)] + [_at(m, 15 <= m < 40, None) for m in range(100)]
    out = _stream(spark, [rows], window_minutes=1, density_threshold=0.5, watermark="0 seconds", keys=["account"])
    assert {(r.account, r.tf_start, r.tf_end) for r in out[0]} == {
        ("a", T0 + timedelta(minutes=10), T0 + timedelta(minutes=20)),
        (None, T0 + timedelta(minutes=15), T0 + timedelta(minutes=40))}
    with pytest.raises(ValueError):
        streaming_timeframes(spark.createDataFrame(rows, KIND), "flag", density_threshold=0)
