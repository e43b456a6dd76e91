"""Signature matching and per-user cluster measures described in the reference's documents (DOC-1..4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailsift.functions import scalars as S
from trailsift.session import literal_table

# The reconnaissance API list by category (88 names).
SIGNATURES = {
    "EC2 & compute": [
        "DescribeInstances", "DescribeSecurityGroups", "DescribeVpcs", "DescribeRegions",
        "DescribeAvailabilityZones", "DescribeImages", "DescribeKeyPairs", "DescribeVolumes",
        "DescribeSnapshots", "DescribeNetworkInterfaces", "DescribeRouteTables",
        "DescribeInternetGateways", "DescribeNetworkAcls", "DescribeSubnets", "DescribeAddresses",
        "DescribeLoadBalancers", "DescribeAutoScalingGroups"],
    "S3 & storage": [
        "ListBuckets", "ListObjects", "ListObjectsV2", "GetBucketPolicy",
        "GetBucketPublicAccessBlock", "GetBucketVersioning", "GetBucketEncryption",
        "GetBucketLocation", "GetBucketTagging", "GetBucketAcl", "GetBucketCors",
        "GetBucketLifecycle", "GetBucketReplication"],
    "IAM & identity": [
        "ListUsers", "ListRoles", "ListGroups", "ListPolicies", "ListAttachedUserPolicies",
        "ListAttachedRolePolicies", "ListAttachedGroupPolicies", "GetUser", "GetRole", "GetGroup",
        "GetPolicy", "GetPolicyVersion", "ListAccessKeys", "ListMFADevices",
        "ListServiceSpecificCredentials"],
    "Database & data": [
        "DescribeDBInstances", "DescribeDBClusters", "DescribeDBSnapshots",
        "DescribeDBSubnetGroups", "DescribeDBParameterGroups", "DescribeDBEngineVersions",
        "ListTables", "DescribeTable", "ListFunctions", "GetFunction", "ListEventSourceMappings"],
    "Network & security": [
        "DescribeVpcPeeringConnections", "DescribeVpcEndpoints", "DescribeTransitGateways",
        "DescribeDirectConnectGateways", "DescribeVpnConnections", "DescribeCustomerGateways",
        "DescribeVpnGateways"],
    "Monitoring & logging": [
        "DescribeLogGroups", "DescribeLogStreams", "DescribeAlarms", "DescribeMetrics",
        "ListTrails", "GetTrail", "GetEventSelectors"],
    "Other services": [
        "ListTopics", "ListSubscriptions", "ListQueues", "GetQueueAttributes",
        "ListDistributions", "GetDistribution", "ListHostedZones", "ListResourceRecordSets",
        "ListKeys", "DescribeKey", "ListSecrets", "DescribeSecret"],
    "Configuration & compliance": [
        "ListConfigurationRecorders", "ListConfigRules", "ListConfigRuleEvaluationResults",
        "ListDetectors", "GetDetector", "ListFindings"],
}


def signature_table(spark) -> DataFrame:
    """(eventName, category): 88 fixed rows, safe to broadcast."""
    rows = [(name, cat) for cat, names in SIGNATURES.items() for name in names]
    return literal_table(spark, rows, "eventName STRING, category STRING")


def signature_match(events: DataFrame) -> DataFrame:
    """DOC-1: events whose name is a known reconnaissance API, with its category."""
    return events.join(F.broadcast(signature_table(events.sparkSession)), "eventName", "inner")


def signature_frequency(events: DataFrame) -> DataFrame:
    """DOC-2: how often each listed API occurs; counted first, then matched (88-row broadcast)."""
    counts = events.groupBy("eventName").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(signature_table(events.sparkSession)), "eventName", "inner") \
        .select("category", "eventName", "n")


def distinct_apis_per_user(labelled: DataFrame) -> DataFrame:
    """DOC-3: per cluster, the mean number of distinct APIs per user (user = IAM name)."""
    per_user = (labelled.filter(F.col("cluster") != -1)
                .groupBy("cluster", S.iam_name("userIdentity").alias("user"))
                .agg(F.count_distinct(S.safe_str("eventName")).alias("n_apis")))
    return per_user.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_users"),
                                           F.avg("n_apis").alias("avg_distinct_apis"))


def value_overlap(labelled: DataFrame) -> DataFrame:
    """DOC-4: per cluster, the mean over users of the share of their distinct source IPs,
    user agents and OSes that also occur in another cluster (noise counts as one)."""
    is_os = F.col("kind") == "os"
    base = labelled.select("cluster", S.iam_name("userIdentity").alias("user"),
                           F.explode(F.array(
                               F.struct(F.lit("ip").alias("kind"),
                                        S.safe_str("sourceIPAddress").alias("value")),
                               F.struct(F.lit("ua").alias("kind"),
                                        S.safe_str("userAgent").alias("value")),
                               F.struct(F.lit("os").alias("kind"),
                                        S.guess_os("userAgent").alias("value")))).alias("kv"))
    triples = base.select("cluster", "user", "kv.kind", "kv.value").distinct()
    # A value is shared when its smallest and largest cluster differ: two numbers a value, combined in every task.
    shared = (triples.groupBy("kind", "value").agg(F.min("cluster").alias("lo"), F.max("cluster").alias("hi"))
              .filter("lo < hi").select("kind", "value", F.lit(1.0).alias("shared")))
    clustered = triples.filter(F.col("cluster") != -1)
    # There are only a handful of OS names, each with all users: their rows don't meet by name.
    parts = [clustered.filter(~is_os).join(shared.filter(~is_os), ["kind", "value"], "left"),
             clustered.filter(is_os).join(F.broadcast(shared.filter(is_os)), ["kind", "value"], "left")]
    shares = (parts[0].unionByName(parts[1]).groupBy("cluster", "user", "kind")
              .agg(F.avg(F.coalesce("shared", F.lit(0.0))).alias("share")))
    return shares.groupBy("cluster").pivot("kind", ["ip", "ua", "os"]).agg(F.avg("share")) \
        .select("cluster", F.col("ip").alias("ip_overlap"), F.col("ua").alias("ua_overlap"),
                F.col("os").alias("os_overlap"))
