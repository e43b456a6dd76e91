"""Registered queries: one per operator group of SURVEY §2 (keys of SURVEY §7.3).

Every query reads the given tables (through the ``events`` adapter) over their
whole extent and returns a flat DataFrame whose column names equal those of
the matching oracle SQL in ``trailsift.plans.oracle``. Arrays are rendered as
joined text and doubles rounded so that two engines can be compared.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailsift.functions import scalars as S
from trailsift.operators import filters as FL
from trailsift.operators import profile as P
from trailsift.operators import signatures as SG
from trailsift.operators import timeframes as T
from trailsift.operators.dbscan import dbscan_vectors
from trailsift.operators.features import (FEATURES, RECORD_FIELDS, SCALED, encode, feature_columns,
                                         scaled_columns)
from trailsift.plans.pipeline import cluster_events, detect, flag_events, label_events
from trailsift.session import materialize, table_path
from trailsift.sources import envelopes as EV
from trailsift.sources import sinks as SK
from trailsift.sources.adapter import audit_events, read_table
from trailsift.sources.ingest import Ingested, read_audit_logs
from trailsift.streaming import streaming_timeframes

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the filter queries (fixed so both engines see the same ones).
TIME_START = "2024-01-05T00:00:00Z"
TIME_END = "2024-01-12T12:30:00+00:00"
SERVICES = ["ec2", "s3"]


def _readonly(spark, sf_dir):
    return FL.filter_readonly(audit_events(spark, sf_dir))


def _joined(arr: Column, sep: str = ",") -> Column:
    return F.array_join(arr, sep)


def _r(c: str | Column, places: int = 6) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, places)


def _record_id() -> Column:
    """The adapter's event id carried in each record as ``eventID``."""
    return F.get_json_object("raw", "$.eventID").cast("long").alias("event_id")


# -- sources -----------------------------------------------------------------------------
def q_audit_events(spark, sf_dir):
    return audit_events(spark, sf_dir)


def q_envelope_records(spark, sf_dir):
    """SRC-2/4/6/8/9: records wrapped in envelopes, then unwrapped and typed again."""
    records = EV.records_from_envelopes(EV.envelopes_from_events(audit_events(spark, sf_dir)))
    return records.select(
        _record_id(), F.col("eventTime").cast("timestamp_ntz").alias("eventTime"), "eventName",
        "eventSource", "errorCode", "readOnly", *feature_columns())


def q_json_missing_vs_null(spark, sf_dir):
    """SCL-1 and the missing/null matrix: errorCode is null, absent or set; awsRegion is absent from every record."""
    events = audit_events(spark, sf_dir).withColumn("awsRegion", F.lit(None).cast("string"))
    records = EV.records_from_envelopes(EV.envelopes_from_events(
        events, drop_null_keys=["errorCode", "responseElements", "awsRegion"]))
    absent = Ingested(records, records, records).absent(*RECORD_FIELDS)
    records = records.withColumn("event_id", _record_id())
    present = F.coalesce(F.array_contains(F.json_object_keys("raw"), "errorCode"), F.lit(False))
    as_null, as_nan = feature_columns(missing_as="null"), feature_columns(missing_as="nan", absent=absent)
    each = feature_columns(missing_as="nan")  # without that knowledge: absent here
    return records.select(
        "event_id", present.alias("error_key_present"),
        as_null[10].alias("error_flag_null"), as_null[12].alias("resp_len_null"),
        as_nan[10].alias("error_flag_nan"), as_nan[12].alias("resp_len_nan"),
        as_nan[8].alias("region_everywhere_absent"), each[8].alias("region_absent_here"))


def _log_folders(spark, sf_dir) -> tuple[str, str, str]:
    """Envelopes of ``events`` as files in the shared folder: a folder of ``.json`` files with the even
    events, a folder of texts with the odd ones as lists, and one of truncated texts, one for each
    event type. Records of every tenth event have no ``eventName`` key."""
    events = audit_events(spark, sf_dir).withColumn("eventName", F.when(F.col("event_id") % 10 != 0, F.col("eventName")))
    base = table_path(spark, f"logs-{uuid.uuid4().hex}")

    def wrapped(part):
        return EV.envelopes_from_events(part, records_per_file=2000, drop_null_keys=["eventName"])

    records = F.coalesce(F.from_json("value", "Records array<variant>")["Records"],
                         F.from_json("value", "array<variant>")).alias("Records")
    one_each = {"maxRecordsPerFile": "1"}
    wrapped(events.filter("event_id % 2 = 0")).select(records).write.options(**one_each).json(f"{base}/dir")
    wrapped(events.filter("event_id % 2 = 1")).select("value").write.options(**one_each).text(f"{base}/texts")
    cut = read_table(spark, sf_dir, "events").select("event_type").distinct().select(
        F.concat(F.lit('{"Records": [{"eventName": "'), "event_type").alias("value"))
    cut.write.options(**one_each).text(f"{base}/broken")
    return f"{base}/dir", f"{base}/texts", f"{base}/broken"


def q_ingest_files(spark, sf_dir):
    """SRC-1/2/3/5/6/7, TOP-5, SET-1: a directory, globs and overlapping arguments, read back."""
    folder, texts, broken = _log_folders(spark, sf_dir)
    got = read_audit_logs(spark, [folder, f"{texts}/*.txt", f"{folder}/part-*.json", f"{broken}/*.txt", f"{folder}/none"])
    return got.events.groupBy(_record_id(), "eventName").agg(F.count(F.lit(1)).alias("n"))


def q_large_envelopes(spark, sf_dir):
    """SRC-2/SRC-4: envelopes of 20,000 records each as files that are read by byte ranges, not as rows."""
    path = table_path(spark, f"large-{uuid.uuid4().hex}")
    EV.envelopes_from_events(audit_events(spark, sf_dir), records_per_file=20_000).select("value").write.option(
        "maxRecordsPerFile", 1).text(path)
    got = read_audit_logs(spark, f"{path}/*.txt", large=100_000)
    return got.events.select(_record_id(), "eventTime", "eventName", "userAgent", "readOnly")


def q_bad_files(spark, sf_dir):
    """SRC-5: files that hold no envelope, by reason."""
    folder, _, broken = _log_folders(spark, sf_dir)
    got = read_audit_logs(spark, [folder, f"{broken}/*.txt"])
    return got.bad_files.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def q_absent_fields(spark, sf_dir):
    """FLT-1/2/3 on records that never have the fields: every record is kept."""
    bare = ["eventTime", "eventSource", "readOnly"]
    events = audit_events(spark, sf_dir).withColumns(
        {"eventTime": F.lit(None).cast("timestamp_ntz"), "eventSource": F.lit(None).cast("string"),
         "readOnly": F.lit(None).cast("string")})
    records = EV.records_from_envelopes(EV.envelopes_from_events(events, drop_null_keys=bare))
    absent = Ingested(records, records, records).absent(*bare, "eventName")
    kept = FL.filter_by_services(FL.filter_by_time(records, TIME_START, TIME_END, absent=absent), SERVICES, absent)
    return FL.filter_readonly(kept, absent=absent).select(_record_id(), "eventName")


# -- filters -----------------------------------------------------------------------------
def q_time_range(spark, sf_dir):
    ev = audit_events(spark, sf_dir)
    return FL.filter_by_time(ev, TIME_START, TIME_END).select("event_id", "eventTime", "eventName")


def q_service_filter(spark, sf_dir):
    ev = audit_events(spark, sf_dir)
    return FL.filter_by_services(ev, SERVICES).select("event_id", "eventSource")


def q_readonly_filter(spark, sf_dir):
    return _readonly(spark, sf_dir).select("event_id", "readOnly", "eventName")


# -- scalar functions --------------------------------------------------------------------
def q_scalar_hash32(spark, sf_dir):
    ev = audit_events(spark, sf_dir)
    return ev.select("event_id", S.hash32("eventName").alias("h_name"),
                     S.hash32("userAgent").alias("h_agent"),
                     S.hash32("errorCode").alias("h_error"),
                     S.hash32("awsRegion").alias("h_region"))


def q_scalar_ip_int(spark, sf_dir):
    ev = audit_events(spark, sf_dir)
    host = F.concat(F.lit("host-"), F.col("sourceIPAddress"), F.lit(".example"))
    wide = F.concat(F.lit("3"), F.col("sourceIPAddress"))
    return ev.select("event_id", S.ip_to_int("sourceIPAddress").alias("ip_int"),
                     S.ip_to_int(host).alias("host_int"), S.ip_to_int(wide).alias("wide_int"))


def q_scalar_user_agent_num(spark, sf_dir):
    ev = audit_events(spark, sf_dir)
    return ev.select("event_id", S.user_agent_num("userAgent").alias("ua_num"),
                     S.user_agent_num("errorCode").alias("err_num"))


# A JSON value with nesting, separators inside strings, escapes and non-ASCII text.
RICH_JSON_PREFIX = '{"a": [1, 2, {"b": "x:y, z"}], "q": "say \\"hi\\"", "e": "café \U0001F600", "k": '


def q_scalar_json_length(spark, sf_dir):
    ev = audit_events(spark, sf_dir)
    rich = F.concat(F.lit(RICH_JSON_PREFIX), F.col("event_id").cast("string"), F.lit("}"))
    return ev.select("event_id", S.json_length("requestParameters").alias("req_len"),
                     S.json_length("responseElements").alias("resp_len"),
                     S.json_length(rich).alias("rich_len"))


def q_scalar_num_keys(spark, sf_dir):
    ev = audit_events(spark, sf_dir)
    return ev.select("event_id", S.num_keys("requestParameters").alias("req_keys"),
                     S.num_keys("userIdentity").alias("ident_keys"),
                     S.num_keys("sessionContext").alias("session_keys"))


def q_scalar_os(spark, sf_dir):
    ev = audit_events(spark, sf_dir)
    return ev.select("event_id", S.guess_os("userAgent").alias("os"))


def q_identity_tuple(spark, sf_dir):
    ev = audit_events(spark, sf_dir)
    return ev.select("event_id", *T.identity_columns(),
                     S.identity_type("userIdentity").alias("identity_type"),
                     S.session_issuer_type("sessionContext").alias("issuer_type"))


# -- features, scaling, clustering --------------------------------------------------------
def q_features_encoded(spark, sf_dir):
    return encode(_readonly(spark, sf_dir), keep=["event_id"])


def q_features_scaled(spark, sf_dir):
    from trailsift.operators.features import collapse, scale_stats
    feats = encode(_readonly(spark, sf_dir), keep=["event_id"])
    stats = scale_stats(materialize(collapse(feats), "collapsed"))
    return feats.select("event_id", *[_r(c).alias(z)
                                      for c, z in zip(scaled_columns(stats), SCALED)])


def q_neighbour_counts(spark, sf_dir):
    feats = encode(_readonly(spark, sf_dir), keep=[])
    vec = dbscan_vectors(feats, exact_counts=True).vectors
    return vec.select(*FEATURES, "w", "nbr_weight", "core")


def q_dbscan_labels(spark, sf_dir):
    labelled, _ = label_events(_readonly(spark, sf_dir))
    return labelled.select("event_id", "cluster")


def q_cluster_totals(spark, sf_dir):
    _, vectors = cluster_events(_readonly(spark, sf_dir))
    return P.vector_totals(vectors)


def q_cluster_profile(spark, sf_dir):
    _, vectors = cluster_events(_readonly(spark, sf_dir))
    prof = P.vector_profile(vectors)
    return prof.select("cluster", "size", _r("error_rate", 9).alias("error_rate"),
                       _joined(F.col("event_names")).alias("event_names"), "n_event_names")


def q_cluster_names_limited(spark, sf_dir):
    _, vectors = cluster_events(_readonly(spark, sf_dir))
    lim = P.names_limited(P.vector_profile(vectors), limit=2)
    return lim.select("cluster", "names_shown", F.col("more_names").cast("long").alias("more_names"))


def q_top_clusters(spark, sf_dir):
    _, vectors = cluster_events(_readonly(spark, sf_dir))
    top = P.top_clusters(P.vector_profile(vectors))
    return top.select("cluster", _r("error_rate", 9).alias("error_rate"), "size",
                      F.col("rank").cast("long").alias("rank"))


def q_suspicious_events(spark, sf_dir):
    feats, vectors = cluster_events(_readonly(spark, sf_dir))
    return flag_events(feats, vectors, P.top_clusters(P.vector_profile(vectors)), "inner").select("event_id", "cluster")


def q_suspicious_summary(spark, sf_dir):
    d = detect(audit_events(spark, sf_dir))
    return d.summary.select(_joined(F.col("suspicious_clusters").cast("array<string>"))
                            .alias("suspicious_clusters"),
                            "suspicious_count", "total_readonly", "suspicious_pct")


# -- minute series and timeframes ---------------------------------------------------------
def _error_flag() -> Column:
    return F.col("errorCode").isNotNull()


def q_minute_counts(spark, sf_dir):
    return T.minute_counts(_readonly(spark, sf_dir), _error_flag())


def q_minute_spine(spark, sf_dir):
    return T.minute_spine(T.minute_counts(_readonly(spark, sf_dir), _error_flag()))


def q_rolling_density(spark, sf_dir):
    minutes = T.minute_counts(_readonly(spark, sf_dir), _error_flag())
    rolled = T.rolling_density(minutes, 60, T.last_minute_literal(minutes))
    return rolled.filter(F.col("roll_total") > 0).select(
        "minute", "roll_total", "roll_susp", _r("density", 9).alias("density"))


def q_error_timeframes(spark, sf_dir):
    tfs = T.detect_timeframes(_readonly(spark, sf_dir), _error_flag(), 60, 0.10)
    return tfs.select("tf_start", "tf_end", _r("confidence", 9).alias("confidence"))


def q_timeframes_stream(spark, sf_dir):
    """§2.12: the events as a stream; its timeframes up to the last event's time, less the run open then."""
    folder = table_path(spark, f"stream-{uuid.uuid4().hex}")
    source = _readonly(spark, sf_dir).select(F.col("eventTime").cast("timestamp").alias("eventTime"), "eventName",
                                             F.coalesce(_error_flag(), F.lit(False)).alias("flag"))
    source.write.parquet(f"{folder}/source")
    stream = spark.readStream.schema(source.schema).parquet(f"{folder}/source")
    found = streaming_timeframes(stream, "flag", 60, 0.10, watermark="0 seconds")
    run = (found.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/rows")
           .option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start())
    run.awaitTermination()
    rows = spark.read.schema(found.schema).parquet(f"{folder}/rows")
    return rows.select(F.col("tf_start").cast("timestamp_ntz").alias("tf_start"),
                       F.col("tf_end").cast("timestamp_ntz").alias("tf_end"), _r("confidence", 9).alias("confidence"))


def q_timeframes(spark, sf_dir):
    d = detect(audit_events(spark, sf_dir))
    return d.timeframes.select("tf_start", "tf_end", _r("confidence", 9).alias("confidence"))


def q_timeframes_5min_40pct(spark, sf_dir):
    d = detect(audit_events(spark, sf_dir), window_minutes=5, density_threshold=0.40)
    return d.timeframes.select("tf_start", "tf_end", _r("confidence", 9).alias("confidence"))


def q_timeframe_identities(spark, sf_dir):
    return detect(audit_events(spark, sf_dir)).identities


def q_timeframe_identities_distinct(spark, sf_dir):
    return detect(audit_events(spark, sf_dir)).identities_distinct


def q_timeframe_apis(spark, sf_dir):
    d = detect(audit_events(spark, sf_dir))
    return d.apis.select("tf_start", _joined(F.col("example_apis")).alias("example_apis"),
                         "n_identities")


def q_timeframe_report(spark, sf_dir):
    d = detect(audit_events(spark, sf_dir))
    return d.report.select(F.col("ordinal").cast("long").alias("ordinal"), "period_start",
                           "period_end", "duration_seconds", "confidence_pct",
                           F.col("n_apis").cast("long").alias("n_apis"), "apis_shown",
                           "identities_shown",
                           "n_identities", "more_identities")


# -- sinks: the written text, parsed again -----------------------------------------------------
def q_clusters_json(spark, sf_dir):
    _, vectors = cluster_events(_readonly(spark, sf_dir))
    lines = SK.clusters_json_lines(P.vector_profile(vectors))
    rec = lines.select(F.from_json("json", "cluster_id int, size long, error_rate double, event_names array<string>")
                       .alias("r"))
    return rec.select("r.cluster_id", "r.size", _r("r.error_rate", 9).alias("error_rate"),
                      _joined(F.col("r.event_names")).alias("event_names"))


def q_clusters_document(spark, sf_dir):
    """SNK-1 as one document of several parts, read back as one JSON value (a row per cluster and name in it)."""
    _, vectors = cluster_events(_readonly(spark, sf_dir))
    path = table_path(spark, f"document-{uuid.uuid4().hex}")
    SK.write_json_document(SK.clusters_pieces(P.vector_profile(vectors)), "clusters", path)
    lines = spark.read.text(path).select(F.struct("_metadata.file_path", F.monotonically_increasing_id().alias("line"),
                                                  "value").alias("l"))
    text = lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["value"]), "\n").alias("t"))
    found = text.select(F.explode(F.from_json("t", "struct<clusters: array<struct<cluster_id: int, size: long, "
                                                   "error_rate: double, event_names: array<string>>>>")["clusters"]).alias("r"))
    return found.select("r.cluster_id", "r.size", _r("r.error_rate", 9).alias("error_rate"),
                        _joined(F.col("r.event_names")).alias("event_names"))


def q_suspicious_json(spark, sf_dir):
    lines = SK.suspicious_json(detect(audit_events(spark, sf_dir)).summary)
    rec = lines.select(F.from_json(
        "json", "suspicious_clusters array<int>, suspicious_count long, total_readonly long").alias("r"))
    return rec.select(_joined(F.col("r.suspicious_clusters").cast("array<string>")).alias("suspicious_clusters"),
                      "r.suspicious_count", "r.total_readonly")


def q_timeframes_json(spark, sf_dir):
    d = detect(audit_events(spark, sf_dir))
    lines = SK.timeframes_json_lines(d.timeframes, d.apis, d.identities)
    rec = lines.select(F.from_json(
        "json", "start string, end string, confidence double, part long, identities array<array<string>>, "
                "n_identities long, example_apis array<string>").alias("r"))
    tuples = F.transform("r.identities", lambda t: F.array_join(t, " / "))
    return rec.select(F.col("r.start").alias("period_start"), F.col("r.end").alias("period_end"),
                      _r("r.confidence", 9).alias("confidence"), "r.part", F.array_join(tuples, " || ").alias("identities"),
                      "r.n_identities", _joined(F.col("r.example_apis")).alias("example_apis"))


def q_timeframes_csv(spark, sf_dir):
    rows = SK.timeframes_csv_rows(detect(audit_events(spark, sf_dir)).report)
    return rows.withColumn("ordinal", F.col("ordinal").cast("long"))


def q_sections_written(spark, sf_dir):
    """SNK-7: sections written by name and format, read back from the files (a row per cluster, summary and timeframe)."""
    d = detect(audit_events(spark, sf_dir))
    at = table_path(spark, f"sections-{uuid.uuid4().hex}")
    for section, fmt in (("clusters", "csv"), ("suspicious", "json"), ("timeframes", "csv")):
        SK.write_section(d, section, fmt, f"{at}/{section}")
    clusters = spark.read.csv(f"{at}/clusters", header=True).select(
        F.lit("clusters").alias("section"), F.col("cluster").alias("name"), F.col("size").cast("long").alias("n"))
    summary = spark.read.json(f"{at}/suspicious").select(
        F.lit("suspicious").alias("section"), _joined(F.col("suspicious_clusters").cast("array<string>")).alias("name"),
        F.col("suspicious_count").cast("long").alias("n"))
    frames = spark.read.csv(f"{at}/timeframes", header=True).select(
        F.lit("timeframes").alias("section"), F.col("period_start").alias("name"),
        F.col("duration_seconds").cast("long").alias("n"))
    return clusters.unionByName(summary).unionByName(frames)


def q_empty_range(spark, sf_dir):
    """SRC-10: a time range without events leaves every result of the detection empty (a row per result)."""
    d = detect(audit_events(spark, sf_dir), start_time="2100-01-01")
    counts = [getattr(d, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("result"), "n")
              for name in ("readonly", "profile", "chosen", "timeframes", "identities", "apis", "report")]
    return reduce(DataFrame.unionByName, counts)


def q_names_by_prefix(spark, sf_dir):
    """SCL-13, AGG-12 on dotted names: hosts and plain event names of each hour of the day, by prefix."""
    ev = audit_events(spark, sf_dir)
    names = ev.select(F.hour("eventTime").alias("hour"), F.explode(F.array("eventSource", "eventName")).alias("name"))
    found = names.filter(F.col("name").isNotNull()).groupBy("hour").agg(F.sort_array(F.collect_set("name")).alias("names"))
    return found.select("hour", T.grouped_by_prefix(F.col("names")).alias("names_shown"))


def q_timeframes_signature(spark, sf_dir):
    """DOC-1 as the first stage of the detection."""
    d = detect(audit_events(spark, sf_dir), approach="signature")
    return d.timeframes.select("tf_start", "tf_end", _r("confidence", 9).alias("confidence"))


# -- signatures and per-user measures (documents of the reference) ---------------------------
def q_signature_match(spark, sf_dir):
    return SG.signature_match(audit_events(spark, sf_dir)).select("event_id", "eventName",
                                                                    "category")


def q_signature_frequency(spark, sf_dir):
    return SG.signature_frequency(audit_events(spark, sf_dir))


def q_distinct_apis_per_user(spark, sf_dir):
    labelled = materialize(label_events(_readonly(spark, sf_dir))[0], "labelled")
    out = SG.distinct_apis_per_user(labelled)
    return out.select("cluster", "n_users", _r("avg_distinct_apis", 9).alias("avg_distinct_apis"))


def q_value_overlap(spark, sf_dir):
    labelled = materialize(label_events(_readonly(spark, sf_dir))[0], "labelled")
    out = SG.value_overlap(labelled)
    return out.select("cluster", *[_r(c, 9).alias(c) for c in out.columns if c != "cluster"])


QUERIES: dict[str, Query] = {
    "audit_events": q_audit_events,
    "envelope_records": q_envelope_records,
    "json_missing_vs_null": q_json_missing_vs_null,
    "ingest_files": q_ingest_files,
    "large_envelopes": q_large_envelopes,
    "bad_files": q_bad_files,
    "absent_fields": q_absent_fields,
    "time_range": q_time_range,
    "service_filter": q_service_filter,
    "readonly_filter": q_readonly_filter,
    "scalar_hash32": q_scalar_hash32,
    "scalar_ip_int": q_scalar_ip_int,
    "scalar_user_agent_num": q_scalar_user_agent_num,
    "scalar_json_length": q_scalar_json_length,
    "scalar_num_keys": q_scalar_num_keys,
    "scalar_os": q_scalar_os,
    "identity_tuple": q_identity_tuple,
    "features_encoded": q_features_encoded,
    "features_scaled": q_features_scaled,
    "neighbour_counts": q_neighbour_counts,
    "dbscan_labels": q_dbscan_labels,
    "cluster_totals": q_cluster_totals,
    "cluster_profile": q_cluster_profile,
    "cluster_names_limited": q_cluster_names_limited,
    "top_clusters": q_top_clusters,
    "suspicious_events": q_suspicious_events,
    "suspicious_summary": q_suspicious_summary,
    "minute_counts": q_minute_counts,
    "minute_spine": q_minute_spine,
    "rolling_density": q_rolling_density,
    "error_timeframes": q_error_timeframes,
    "timeframes_stream": q_timeframes_stream,
    "timeframes": q_timeframes,
    "timeframes_5min_40pct": q_timeframes_5min_40pct,
    "timeframe_identities": q_timeframe_identities,
    "timeframe_identities_distinct": q_timeframe_identities_distinct,
    "timeframe_apis": q_timeframe_apis,
    "timeframe_report": q_timeframe_report,
    "clusters_json": q_clusters_json,
    "clusters_document": q_clusters_document,
    "suspicious_json": q_suspicious_json,
    "timeframes_json": q_timeframes_json,
    "timeframes_csv": q_timeframes_csv,
    "sections_written": q_sections_written,
    "empty_range": q_empty_range,
    "names_by_prefix": q_names_by_prefix,
    "timeframes_signature": q_timeframes_signature,
    "signature_match": q_signature_match,
    "signature_frequency": q_signature_frequency,
    "distinct_apis_per_user": q_distinct_apis_per_user,
    "value_overlap": q_value_overlap,
}
