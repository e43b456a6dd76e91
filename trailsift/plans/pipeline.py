"""The whole detection job (ML-7): filters -> encode -> DBSCAN -> top clusters -> timeframes.

``detect`` returns named DataFrames; only the reused intermediates are materialised (the
narrow encoded events, the distinct vectors and their labels inside DBSCAN, the minute
series, the timeframes). Everything else stays lazy so the caller decides what to write.
"""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailsift.operators import profile as P
from trailsift.operators import timeframes as T
from trailsift.operators.dbscan import DEFAULT_EPS, DEFAULT_MIN_SAMPLES, dbscan_vectors
from trailsift.operators.features import FEATURES, encode
from trailsift.operators.filters import filter_by_services, filter_by_time, filter_readonly
from trailsift.operators.signatures import signature_table
from trailsift.session import materialize

# Columns the later steps read; the labelled table keeps only these.
LABELLED_COLUMNS = ["event_id", "eventTime", "eventName", "errorCode", "sourceIPAddress",
                    "userIdentity", "userAgent"]


@dataclass
class Detection:
    readonly: DataFrame       # read-only events after the filters
    # vectors, profile, totals and chosen are None with the signature approach
    vectors: DataFrame        # distinct feature vectors with weight, z, core, cluster
    labelled: DataFrame       # LABELLED_COLUMNS + suspicious, cluster and rank of the chosen clusters
    profile: DataFrame        # per cluster: size, error_rate, event_names, n_event_names
    totals: DataFrame         # one row: total, n_clusters, clustered, noise
    chosen: DataFrame         # top_k clusters with rank
    summary: DataFrame        # one row: suspicious_clusters, counts, pct
    timeframes: DataFrame     # tf_start, tf_end, confidence
    tf_events: DataFrame      # suspicious events inside each timeframe
    identities: DataFrame     # tf_start, ord, ip, iam, user_agent, os
    identities_distinct: DataFrame  # tf_start, ip, iam, user_agent, os, n_events, first_ord
    apis: DataFrame           # tf_start, example_apis, n_identities
    report: DataFrame         # display-ready timeframe rows


#: More chosen vectors than this are joined to the events by shuffle instead of broadcast.
BROADCAST_VECTORS = 200_000


def cluster_events(readonly: DataFrame, eps: float = DEFAULT_EPS, min_samples: int = DEFAULT_MIN_SAMPLES,
                   session_path: str = "$.sessionIssuer.type", missing_as: str = "null",
                   keep: list[str] | None = None, absent: Collection[str] = ()):
    """Encode and cluster; returns (encoded events, labelled vectors with ``vector_extras``).

    The encode (JSON parsing, md5 hashes, regexes) runs once: its narrow output is written and
    is the only copy of the events; profiles, totals and the choice follow from the vectors.
    """
    feats = materialize(encode(readonly, keep=keep or LABELLED_COLUMNS, session_path=session_path,
                               missing_as=missing_as, absent=absent), "encoded")
    return feats, dbscan_vectors(feats, eps=eps, min_samples=min_samples, extras=P.vector_extras()).vectors


def label_events(readonly: DataFrame, eps: float = DEFAULT_EPS,
                 min_samples: int = DEFAULT_MIN_SAMPLES, session_path: str = "$.sessionIssuer.type",
                 missing_as: str = "null", keep: list[str] | None = None):
    """Every event with its cluster; returns (labelled, vectors)."""
    keep = keep or LABELLED_COLUMNS
    feats, vectors = cluster_events(readonly, eps, min_samples, session_path, missing_as, keep)
    labelled = feats.join(vectors.select(*FEATURES, "cluster"), FEATURES, "inner")
    return labelled.select(*keep, "cluster"), vectors


def flag_events(feats: DataFrame, vectors: DataFrame, chosen: DataFrame, how: str = "left") -> DataFrame:
    """Events with ``cluster`` and ``rank`` of the chosen clusters (null elsewhere) and ``suspicious``.

    Only the chosen clusters' vectors meet the events, by broadcast up to a checked number.
    """
    wanted = materialize(vectors.join(F.broadcast(chosen.select("cluster", "rank")), "cluster").select(
        *FEATURES, "cluster", "rank"), "chosen-vectors")
    small = wanted.count() <= BROADCAST_VECTORS
    flagged = feats.join(F.broadcast(wanted) if small else wanted, FEATURES, how)
    return flagged.drop(*FEATURES).withColumn("suspicious", F.col("rank").isNotNull())


def detect(events: DataFrame, start_time: str | None = None, end_time: str | None = None,
           services: list[str] | None = None, eps: float = DEFAULT_EPS,
           min_samples: int = DEFAULT_MIN_SAMPLES, top_k: int = P.DEFAULT_TOP_K,
           window_minutes: int = 60, density_threshold: float = 0.10,
           session_path: str = "$.sessionIssuer.type", missing_as: str = "null",
           absent: Collection[str] = (), approach: str = "clustering") -> Detection:
    """The job over ``events``.

    ``absent`` names the fields that no record has (``Ingested.absent``): filters on them keep
    every row, and with ``missing_as="nan"`` they are empty texts, not 'nan'. ``approach``: "clustering" flags the events of the top clusters, "signature" the
    events whose API is on the reconnaissance list; timeframes follow from either flag.
    """
    filtered = filter_by_services(filter_by_time(events, start_time, end_time, absent=absent), services, absent)
    readonly = filter_readonly(filtered, absent=absent)
    if approach == "signature":
        listed = signature_table(events.sparkSession).select("eventName").distinct()
        flagged = (readonly.select(*LABELLED_COLUMNS).join(
            F.broadcast(listed.withColumn("suspicious", F.lit(True))), "eventName", "left")
            .withColumn("suspicious", F.coalesce("suspicious", F.lit(False)))
            .withColumns({"cluster": F.lit(None).cast("int"), "rank": F.lit(None).cast("int")}))
        flagged = materialize(flagged, "flagged")
        vectors = prof = totals = chosen = None
    elif approach == "clustering":
        feats, vectors = cluster_events(readonly, eps, min_samples, session_path, missing_as, absent=absent)
        prof = P.vector_profile(vectors)
        totals = P.vector_totals(vectors)
        chosen = materialize(P.top_clusters(prof, top_k), "chosen")
        flagged = flag_events(feats, vectors, chosen)
    else:
        raise ValueError(f"unknown approach {approach!r}")
    # A few rows that every later step reads: written once, so that the island merge runs once.
    timeframes = materialize(
        T.detect_timeframes(flagged, "suspicious", window_minutes, density_threshold), "timeframes")
    tf_events = T.timeframe_events(timeframes, flagged.filter(F.col("suspicious")))
    return Detection(
        readonly=readonly, vectors=vectors, labelled=flagged, profile=prof,
        totals=totals, chosen=chosen,
        summary=P.suspicious_summary(flagged) if vectors is None else P.vector_summary(vectors, chosen),
        timeframes=timeframes, tf_events=tf_events,
        identities=T.timeframe_identities(tf_events),
        identities_distinct=T.timeframe_identities_distinct(tf_events),
        apis=T.timeframe_apis(tf_events),
        report=T.timeframe_report(timeframes, tf_events))
