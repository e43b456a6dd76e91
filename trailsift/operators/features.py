"""Feature encoding (PRJ-1/2) and standardisation (ML-1, AGG-1).

The 13 features are plain DOUBLE columns ``f00..f12`` computed by one
``select`` of native expressions, so encoding is a narrow, codegen'd step of
the scan stage.
"""

from __future__ import annotations

import math
from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailsift.functions import scalars as S

# Fixed feature order (f00 first); the last one is the primary key of the scan order.
FEATURE_SOURCES = [
    "eventName", "eventSource", "eventCategory", "eventType", "userIdentity.type",
    "sessionContext.sessionIssuer.type", "recipientAccountId", "sourceIPAddress", "awsRegion",
    "userAgent", "errorCode", "requestParameters", "responseElements",
]
FEATURES = [f"f{i:02d}" for i in range(len(FEATURE_SOURCES))]
SCALED = [f"z{i:02d}" for i in range(len(FEATURE_SOURCES))]


#: Record fields that features read (``missing_as="nan"`` tells their absence apart).
RECORD_FIELDS = ("eventName", "eventSource", "eventCategory", "eventType", "userIdentity", "sessionContext",
                 "recipientAccountId", "sourceIPAddress", "awsRegion", "userAgent", "errorCode", "requestParameters",
                 "responseElements")


def _field(name: str, missing_as: str, absent: Collection[str], keys: Column) -> Column:
    """A record field; with ``missing_as='nan'`` the text 'nan' where this record lacks the key but others have it.

    The four states: a value, null, absent here ('nan'), absent from every record (as null, hence '')."""
    col = F.col(name)
    if missing_as != "nan" or name in absent:
        return col
    missing = F.col("raw").isNotNull() & ~F.coalesce(F.array_contains(keys, name), F.lit(False))
    return F.when(missing, F.lit("nan")).otherwise(col)


def feature_columns(session_path: str = "$.sessionIssuer.type", missing_as: str = "null",
                    absent: Collection[str] = (), keys: Column | None = None) -> list[Column]:
    """PRJ-1: the 13 feature expressions, in order, as DOUBLE.

    ``missing_as='nan'`` reproduces the reference's handling of a key that is
    absent from one record but present in others (it becomes the text 'nan');
    it needs the ``raw`` record text (``keys``: the array of its keys, if the rows have it), and in
    ``absent`` the fields that no record has (``Ingested.absent``): those are empty texts.
    """
    m = missing_as
    keys = F.json_object_keys("raw") if keys is None else keys

    def field(name: str) -> Column:
        return _field(name, m, absent, keys)

    ident = field("userIdentity")
    ident_type = F.when(ident == "nan", F.lit("nan")).otherwise(S.identity_type(ident)) \
        if m == "nan" else S.identity_type(ident)
    session = field("sessionContext")
    response = field("responseElements")
    resp_len = S.json_length(response)
    if m == "nan":
        resp_len = F.when(response == "nan", F.lit(3).cast("bigint")).otherwise(resp_len)
    request = field("requestParameters")
    cols = [
        S.hash32(field("eventName")),
        S.hash32(field("eventSource")),
        S.hash32(field("eventCategory")),
        S.hash32(field("eventType")),
        S.hash32(ident_type),
        S.hash32(S.session_issuer_type(session, session_path)),
        S.hash32(field("recipientAccountId")),
        S.ip_to_int(field("sourceIPAddress")),
        S.hash32(field("awsRegion")),
        S.user_agent_num(field("userAgent")),
        S.error_flag(field("errorCode")),
        F.when(request == "nan", F.lit(0)).otherwise(S.num_keys(request)) if m == "nan"
        else S.num_keys(request),
        resp_len,
    ]
    return [c.cast("double").alias(name) for c, name in zip(cols, FEATURES)]


def encode(events: DataFrame, keep: list[str] | None = None,
           session_path: str = "$.sessionIssuer.type", missing_as: str = "null",
           absent: Collection[str] = ()) -> DataFrame:
    """PRJ-2: ``keep`` columns (default: all) followed by ``f00..f12``."""
    keep_cols = events.columns if keep is None else keep
    if missing_as != "nan":
        return events.select(*keep_cols, *feature_columns(session_path, missing_as))
    keyed = events.withColumn("__keys", F.json_object_keys("raw"))  # parsed once for all fields
    return keyed.select(*keep_cols, *feature_columns(session_path, missing_as, absent, F.col("__keys")))


def collapse(features: DataFrame, cols: list[str] = FEATURES, extras: tuple[Column, ...] = ()) -> DataFrame:
    """Distinct vectors with their multiplicity ``w`` and further aggregates (map-side combined)."""
    return features.groupBy(*cols).agg(F.count(F.lit(1)).alias("w"), *extras)


def first_pass_metrics(cols: list[str] = FEATURES, weight: str = "w") -> list[Column]:
    """First pass of AGG-1 over weighted distinct vectors: total weight, weighted sums,
    min/max (the constant guard) and an approximate distinct count (steers the grid axes).

    Usable as a plain aggregation or with ``DataFrame.observe`` on the collapsed
    rows: placed after the collapse's aggregation it runs in the final stage of
    the write, whose task updates Spark applies once per partition even when an
    executor is lost and tasks are re-run.
    """
    w = F.col(weight).cast("double")
    return [F.sum(w).alias("n"),
            *[F.sum(F.col(c) * w).alias(f"s_{c}") for c in cols],
            *[F.min(c).alias(f"lo_{c}") for c in cols],
            *[F.max(c).alias(f"hi_{c}") for c in cols],
            *[F.approx_count_distinct(c).alias(f"d_{c}") for c in cols]]


def scale_stats(vectors: DataFrame, cols: list[str] = FEATURES, weight: str = "w",
                first=None) -> list[dict]:
    """AGG-1 on weighted distinct vectors: mean, population std and constant flag per column.

    Two passes over the (small) collapsed table: means first, then centred
    squares, so large hash values lose no precision. Constant columns are
    detected by ``max = min`` and get scale 1. ``first`` is a row of
    ``first_pass_metrics`` already computed (observed during the collapse write).
    """
    w = F.col(weight).cast("double")
    if first is None:
        first = vectors.agg(*first_pass_metrics(cols, weight)).first()
    n = first["n"] or 0.0
    means = {c: (first[f"s_{c}"] / n if n else 0.0) for c in cols}
    second = vectors.agg(*[F.sum(w * (F.col(c) - F.lit(means[c])) ** 2).alias(f"v_{c}")
                           for c in cols]).first()
    stats = []
    for c in cols:
        const = first[f"lo_{c}"] is None or first[f"lo_{c}"] == first[f"hi_{c}"]
        var = (second[f"v_{c}"] or 0.0) / n if n else 0.0
        stats.append({"col": c, "mean": means[c], "std": math.sqrt(var), "constant": const,
                      "scale": 1.0 if const else math.sqrt(var), "lo": first[f"lo_{c}"],
                      "hi": first[f"hi_{c}"], "distinct": first[f"d_{c}"]})
    return stats


def scaled_columns(stats: list[dict], out: list[str] = SCALED) -> list[Column]:
    """ML-1: (f - mean) / scale, exactly 0 for constant columns."""
    cols = []
    for s, name in zip(stats, out):
        if s["constant"] or s["scale"] == 0:
            cols.append(F.lit(0.0).alias(name))
        else:
            mean, scale = float(s["mean"]), float(s["scale"])
            cols.append(F.expr(f"(`{s['col']}` - CAST('{mean!r}' AS DOUBLE)) / "
                               f"CAST('{scale!r}' AS DOUBLE)").alias(name))
    return cols
