"""Cluster profiles, suspicious-cluster selection and run summaries (ML-3, ML-4; AGG-2..7; TOP-1..4).

One ``groupBy('cluster')`` replaces the reference's one pass per cluster id. The
labelled event table is the input everywhere (``cluster`` = -1 for noise).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailsift.functions import scalars as S

DEFAULT_TOP_K = 3


def vector_extras() -> tuple:
    """Aggregates for ``dbscan_vectors(extras=...)`` from which profiles follow without the events."""
    return (F.count("errorCode").alias("n_errors"), F.collect_set(S.safe_str("eventName")).alias("names"))


def vector_profile(vectors: DataFrame) -> DataFrame:
    """``cluster_profile`` from the labelled vectors (with ``vector_extras``)."""
    return (vectors.filter(F.col("cluster") != -1).groupBy("cluster").agg(
        F.sum("w").alias("size"),
        (F.sum("n_errors") / F.sum("w")).alias("error_rate"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("names")))).alias("event_names"))
            .withColumn("n_event_names", F.size("event_names").cast("long")))


def vector_totals(vectors: DataFrame) -> DataFrame:
    """``cluster_totals`` from the labelled vectors."""
    w = F.coalesce(F.sum("w"), F.lit(0))
    noise = F.coalesce(F.sum(F.when(F.col("cluster") == -1, F.col("w"))), F.lit(0))
    return vectors.agg(w.alias("total"), F.count_distinct(F.when(F.col("cluster") != -1, F.col("cluster"))).alias(
        "n_clusters"), (w - noise).alias("clustered"), noise.alias("noise"))


def cluster_profile(labelled: DataFrame) -> DataFrame:
    """ML-3 / AGG-2..5: per cluster (noise excluded) size, error rate, sorted distinct names."""
    return (labelled.filter(F.col("cluster") != -1).groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"),
        F.avg(F.col("errorCode").isNotNull().cast("double")).alias("error_rate"),
        F.array_sort(F.collect_set(S.safe_str("eventName"))).alias("event_names"))
            .withColumn("n_event_names", F.size("event_names").cast("long")))


def cluster_totals(labelled: DataFrame) -> DataFrame:
    """AGG-6: total rows, clusters, clustered rows, noise rows (one row)."""
    return labelled.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_distinct(F.when(F.col("cluster") != -1, F.col("cluster"))).alias("n_clusters"),
        F.count_if(F.col("cluster") != -1).alias("clustered"),
        F.count_if(F.col("cluster") == -1).alias("noise"))


def top_clusters(profile: DataFrame, top_k: int = DEFAULT_TOP_K) -> DataFrame:
    """TOP-1: the ``top_k`` clusters by error rate, then size (desc), then id (asc), with rank.

    ``orderBy + limit`` plans as a partial top-k per partition (TakeOrderedAndProject);
    the rank window then runs over at most ``top_k`` rows.
    """
    order = [F.desc("error_rate"), F.desc("size"), F.asc("cluster")]
    best = profile.orderBy(*order).limit(top_k)
    return best.select("cluster", "error_rate", "size",
                       F.row_number().over(Window.orderBy(*order)).alias("rank"))


def suspicious_events(labelled: DataFrame, chosen: DataFrame) -> DataFrame:
    """FLT-5 / JOIN-5: events of the chosen clusters (``chosen`` has at most ``top_k`` rows)."""
    return labelled.join(F.broadcast(chosen.select("cluster")), "cluster", "left_semi")


def flag_suspicious(labelled: DataFrame, chosen: DataFrame) -> DataFrame:
    """Add ``suspicious`` and the selection ``rank`` to every labelled event (broadcast of <= top_k ids)."""
    ids = chosen.select("cluster", "rank")
    return (labelled.join(F.broadcast(ids), "cluster", "left")
            .withColumn("suspicious", F.col("rank").isNotNull()))


def suspicious_summary(flagged: DataFrame) -> DataFrame:
    """AGG-7: chosen ids (in selection order), suspicious rows, read-only rows, ratio in percent."""
    ranked_ids = F.array_sort(F.collect_set(F.when(
        F.col("suspicious"), F.struct(F.col("rank").alias("r"), F.col("cluster").alias("c")))))
    return flagged.agg(
        F.transform(ranked_ids, lambda s: s.getField("c")).alias("suspicious_clusters"),
        F.count_if("suspicious").alias("suspicious_count"),
        F.count(F.lit(1)).alias("total_readonly"),
    ).withColumn("suspicious_pct", F.round(S.percent("suspicious_count", "total_readonly"), 1))


def vector_summary(vectors: DataFrame, chosen: DataFrame) -> DataFrame:
    """AGG-7 from the labelled vectors."""
    ranked = vectors.join(F.broadcast(chosen.select("cluster", "rank")), "cluster", "left").select(
        "cluster", "rank", "w", F.col("rank").isNotNull().alias("suspicious"))
    ids = F.array_sort(F.collect_set(F.when(F.col("suspicious"), F.struct(
        F.col("rank").alias("r"), F.col("cluster").alias("c")))))
    return ranked.agg(
        F.transform(ids, lambda s: s.getField("c")).alias("suspicious_clusters"),
        F.coalesce(F.sum(F.when(F.col("suspicious"), F.col("w"))), F.lit(0)).alias("suspicious_count"),
        F.coalesce(F.sum("w"), F.lit(0)).alias("total_readonly"),
    ).withColumn("suspicious_pct", F.round(S.percent("suspicious_count", "total_readonly"), 1))


def names_limited(profile: DataFrame, limit: int = 20) -> DataFrame:
    """SNK-5 data / TOP-3 / AGG-12: the first ``limit`` names grouped by prefix, plus the remainder."""
    from trailsift.operators.timeframes import grouped_by_prefix
    # WIN-8: clusters are numbered 0, 1, ... so the display ordinal is the id + 1.
    return profile.select(
        (F.col("cluster") + 1).alias("ordinal"), "cluster", "size", "error_rate", "n_event_names",
        grouped_by_prefix(F.slice("event_names", 1, limit)).alias("names_shown"),
        F.greatest(F.size("event_names") - limit, F.lit(0)).alias("more_names"))
