"""Adapter: the generic ``events`` test table -> audit events.

A fixed, pure-expression mapping, so the DuckDB oracle can restate it in SQL.
``u`` is ``user_id`` and ``k`` the integer in ``props`` (``{"k": n}``).
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailsift.sources.schema import AUDIT_COLUMNS

# Fixed values of the mapping (shared with the oracle SQL).
USER_AGENTS = [
    "aws-cli/2.0.0 Python/3.7.3 Linux/4.19",
    "[Boto3/1.9.201 Python/2.7.12 Linux/4.4.0]",
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64)",
    "aws-cli/1.16 Darwin/18.7.0",
    "console.amazonaws.com",
]
VIEW_NAMES = ["DescribeInstances", "ListBuckets", "DescribeVpcs"]
CLICK_NAMES = ["GetBucketAcl", "ListUsers"]
ERROR_NAMES = ["GetUser", "ListRoles", "ListBuckets", "DescribeInstances"]
IDENTITY_TYPES = ["IAMUser", "AssumedRole", "Root"]
REGIONS = ["us-east-1", "us-west-2"]


def _pick(index: Column, values: list[str]) -> Column:
    expr = None
    for i, v in enumerate(values):
        expr = F.when(index == i, F.lit(v)) if expr is None else expr.when(index == i, F.lit(v))
    return expr


def audit_events_from(events: DataFrame) -> DataFrame:
    u = F.col("user_id")
    k = F.col("k")  # parsed once for all its uses
    events = events.withColumn("k", F.expr("try_cast(get_json_object(props, '$.k') AS INT)"))
    et = F.col("event_type")
    name = (F.when(et == "view", _pick(k % 3, VIEW_NAMES))
            .when(et == "click", _pick(k % 2, CLICK_NAMES))
            .when(et == "error", _pick(k % 4, ERROR_NAMES))
            .when(et == "purchase", F.lit("RunInstances"))
            .when(et == "signup", F.lit("CreateUser")))
    ident_kind = u % 3
    user_text = u.cast("string")
    identity = (F.when(ident_kind == 0, F.concat(
        F.lit('{"type":"IAMUser","arn":"arn:aws:iam::12345678901'), (u % 2).cast("string"),
        F.lit(":user/u"), user_text, F.lit('"}')))
        .when(ident_kind == 1, F.concat(F.lit('{"type":"AssumedRole","userName":"user'),
                                        user_text, F.lit('"}')))
        .otherwise(F.concat(F.lit('{"type":"Root","principalId":"AID'), user_text, F.lit('"}'))))
    session = F.when(ident_kind == 1, F.lit('{"sessionIssuer":{"type":"Role"}}'))
    error = (F.when((et == "error") & (k % 4 != 3), F.lit("AccessDenied"))
             .when(et == "error", F.lit("Client.UnauthorizedOperation"))
             .when((et == "click") & (F.col("value") < 5), F.lit("ThrottlingException")))
    with_name = events.select("event_id", "ts", "user_id", "event_type", "value", "props", "k",
                              name.alias("eventName"))
    n = F.col("eventName")
    source = (F.when(n.startswith("Describe") | (n == "RunInstances"), F.lit("ec2.amazonaws.com"))
              .when(n.isin("ListBuckets", "GetBucketAcl"), F.lit("s3.amazonaws.com"))
              .otherwise(F.lit("iam.amazonaws.com")))
    out = with_name.select(
        F.col("event_id"),
        F.col("ts").alias("eventTime"),
        n,
        source.alias("eventSource"),
        F.lit("Management").alias("eventCategory"),
        F.lit("AwsApiCall").alias("eventType"),
        identity.alias("userIdentity"),
        session.alias("sessionContext"),
        (u % 2).cast("string").alias("recipientAccountId"),
        _pick(u % 2, REGIONS).alias("awsRegion"),
        F.concat(F.lit("10.0."), (u % 4).cast("string"), F.lit("."), (u % 8).cast("string"))
        .alias("sourceIPAddress"),
        _pick(u % 5, USER_AGENTS).alias("userAgent"),
        error.alias("errorCode"),
        F.when(et != "view", F.col("props")).alias("requestParameters"),
        F.when(et == "click", F.col("props")).alias("responseElements"),
        F.when(et.isin("view", "click", "error"), F.lit("true")).otherwise(F.lit("false"))
        .alias("readOnly"),
        F.lit(None).cast("string").alias("raw"),
    )
    return out.select(*AUDIT_COLUMNS)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit events derived from ``{sf_dir}/events.parquet``.

    A row group is read by one task, and a compact table has few of them: the rows are dealt anew
    before the mapping and what follows, so that all cores share that work. Filters and the choice
    of columns still reach the scan.
    """
    return audit_events_from(read_table(spark, sf_dir, "events").hint("rebalance"))
