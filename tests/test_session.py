"""Session helpers: literal lookup tables and statistics observed during a write."""

import numpy as np
from pyspark.sql import Observation
from pyspark.sql import functions as F

from trailsift.operators.components import dense_index
from trailsift.operators.features import collapse, first_pass_metrics, scale_stats
from trailsift.session import literal_table, materialize


def test_literal_table_round_trips_awkward_values(spark):
    rows = [("it's", 1, True), ("back\\slash \\' mix", 2, False),
            ('café 😀 "q"\nline', None, None), (None, 3, True)]
    got = [tuple(r) for r in literal_table(spark, rows, "a STRING, b LONG, c BOOLEAN").collect()]
    assert got == rows


def test_literal_table_is_a_local_relation(spark):
    df = literal_table(spark, [("x", 1)], "name STRING, n INT")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" in plan and "PythonRDD" not in plan
    assert literal_table(spark, [], "name STRING, n INT").count() == 0


def test_observed_first_pass_equals_two_pass(spark):
    rng = np.random.default_rng(7)
    base = rng.integers(-2**31, 2**31, size=(40, 3)).astype(float)
    rows = [tuple(map(float, base[i % 40])) + (float(i % 5),) for i in range(700)]
    df = spark.createDataFrame(rows, "f00 DOUBLE, f01 DOUBLE, f02 DOUBLE, f03 DOUBLE")
    df = df.withColumn("f04", F.lit(12345.0))          # constant column
    cols = ["f00", "f01", "f02", "f03", "f04"]
    obs = Observation()
    vectors = materialize(collapse(df, cols).observe(obs, *first_pass_metrics(cols)))
    observed = scale_stats(vectors, cols, first=obs.get)
    two_pass = scale_stats(vectors, cols)
    assert observed == two_pass
    assert obs.get["n"] == 700
    assert observed[4]["constant"] and observed[4]["scale"] == 1.0
    # Approximate distinct counts (default relative standard deviation 5%).
    for got, true in zip([s["distinct"] for s in observed], [40, 40, 40, 5, 1]):
        assert abs(got - true) <= 0.15 * true


def test_dense_index_offsets_span_partitions(spark):
    df = spark.range(0, 1000, 1, 7).select(((F.col("id") * 7919) % 1000).alias("k"))
    out = dense_index(df, ["k"], "idx", partitions=5)
    got = sorted((r["k"], r["idx"]) for r in out.collect())
    assert got == [(k, k) for k in range(1000)]


def test_one_row_group_is_shared_by_all_cores(spark, tmp_path):
    """The work on events follows the cores, not the few row groups of a compact table."""
    from trailsift.sources.adapter import audit_events
    rows = spark.range(0, 400_000, 1, 1).selectExpr(
        "id AS event_id", "CAST('2024-01-01' AS timestamp_ntz) AS ts", "xxhash64(id) AS user_id", "'view' AS event_type",
        "CAST(id AS double) AS value", "concat('{\"k\": ', id % 9, ', \"x\": \"', md5(string(id)), '\"}') AS props")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    written = materialize(audit_events(spark, str(tmp_path)))
    assert len(written.inputFiles()) >= 2 and written.count() == 400_000
    plan = audit_events(spark, str(tmp_path)).filter("eventName = 'ListBuckets'").select("event_id")
    assert plan.count() == sum(1 for i in range(400_000) if i % 9 % 3 == 1)
