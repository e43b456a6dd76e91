"""Writers for the detection results (SNK-1..7).

Results are written as JSON lines / CSV by Spark's writers, one record per cluster or timeframe, or (format
``document``) as one JSON document: ``{"clusters": [...]}``, ``{"suspicious_timeframes": [...]}``. A document's
lines are numbered and range partitioned, each task writes its own part, and the parts joined in the order of
their names (``cat part-*``, ``hadoop fs -getmerge``) are the document; nothing is assembled on the driver.
A timeframe's identities are complete: lists of more than ``IDENTITIES_PER_LINE`` input positions continue on
further lines (JSON lines: with ``part`` 0, 1, ...), so that no single row grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType
from pyspark.sql.window import Window

from trailsift.functions import scalars as S
from trailsift.operators.components import dense_index
from trailsift.session import materialize

IDENTITIES_PER_LINE = 10_000


def clusters_json_lines(profile: DataFrame) -> DataFrame:
    """SNK-1: ``{"cluster_id", "size", "error_rate", "event_names"}`` per cluster."""
    return profile.select("cluster", F.to_json(F.struct(
        F.col("cluster").alias("cluster_id"), "size", "error_rate", "event_names")).alias("json"))


def suspicious_json(summary: DataFrame) -> DataFrame:
    """SNK-2: ``{"suspicious_clusters", "suspicious_count", "total_readonly"}``."""
    return summary.select(F.to_json(F.struct(
        "suspicious_clusters", "suspicious_count", "total_readonly")).alias("json"))


def timeframes_json_lines(timeframes: DataFrame, apis: DataFrame, identities: DataFrame,
                          per_line: int = IDENTITIES_PER_LINE) -> DataFrame:
    """SNK-3: lines of a timeframe: start, end, confidence, part, identities, their total, APIs.

    Part 0 carries the APIs; every identity is on exactly one line, in input order. A part
    covers ``per_line`` input positions (event ids), hence at most that many identities.
    """
    part = F.coalesce("part", F.lit(0))
    return _timeframe_parts(timeframes, apis, identities, per_line).select("tf_start", F.to_json(F.struct(
        "start", "end", "confidence", part.alias("part"),
        F.coalesce("identities", F.array().cast("array<array<string>>")).alias("identities"),
        F.coalesce("n_identities", F.lit(0)).alias("n_identities"),
        F.when(part == 0, F.coalesce("example_apis", F.array().cast("array<string>")))
        .otherwise(F.array().cast("array<string>")).alias("example_apis"),
    )).alias("json"))


def _timeframe_parts(timeframes: DataFrame, apis: DataFrame, identities: DataFrame, per_line: int) -> DataFrame:
    """A row per timeframe and part of its identity list (one row without identities, ``part`` null)."""
    zoned = isinstance(timeframes.schema["tf_start"].dataType, TimestampType)
    shares = identities.withColumn("share", F.floor(F.col("ord") / per_line)).groupBy("tf_start", "share").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", F.array("ip", "iam", "user_agent", "os").alias("t")))),
                    lambda s: s.getField("t")).alias("identities"))
    # Numbered among the parts of a timeframe: a few small keys, the lists are joined after that.
    order = Window.partitionBy("tf_start").orderBy("share")
    numbers = shares.select("tf_start", "share").withColumns(
        {"part": F.row_number().over(order) - 1, "more": F.lead("share").over(order).isNotNull()})
    parts = shares.join(numbers, ["tf_start", "share"])
    return (timeframes.join(apis, "tf_start", "left").join(parts, "tf_start", "left")
            .withColumns({"start": S.iso_time("tf_start", zoned), "end": S.iso_time("tf_end", zoned)}))


def clusters_pieces(profile: DataFrame) -> DataFrame:
    """(order, opens, text): the elements of the clusters document, by cluster number."""
    return clusters_json_lines(profile).select(F.struct("cluster").alias("order"), F.lit(True).alias("opens"),
                                               F.col("json").alias("text"))


def timeframes_pieces(timeframes: DataFrame, apis: DataFrame, identities: DataFrame,
                      per_line: int = IDENTITIES_PER_LINE) -> DataFrame:
    """(order, opens, text): the elements of the timeframes document; a long one goes on in further pieces."""
    part = F.coalesce("part", F.lit(0))
    head = F.to_json(F.struct("start", "end", "confidence", F.coalesce(
        "example_apis", F.array().cast("array<string>")).alias("example_apis")))
    inner = F.coalesce(F.regexp_replace(F.to_json("identities"), r"^\[|\]$", ""), F.lit(""))
    return _timeframe_parts(timeframes, apis, identities, per_line).select(
        F.struct("tf_start", part.alias("part")).alias("order"), (part == 0).alias("opens"), F.concat(
            F.when(part == 0, F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"identities":['))).otherwise(","),
            inner, F.when(F.coalesce("more", F.lit(False)), "").otherwise("]}")).alias("text"))


def write_json_document(pieces: DataFrame, key: str, path: str, mode: str = "overwrite") -> None:
    """One JSON document ``{key: [...]}`` in parts; ``pieces`` are (order, opens, text)."""
    numbered = materialize(dense_index(pieces, ["order"], "idx"), "document")
    n = numbered.count()
    if n == 0:
        pieces.sparkSession.range(1).select(F.lit(f'{{"{key}": []}}')).coalesce(1).write.mode(mode).text(path)
        return
    start = F.when(F.col("idx") == 0, f'{{"{key}": [').when(F.col("opens"), ",").otherwise("")
    end = F.when(F.col("idx") == n - 1, "]}").otherwise("")
    (numbered.repartitionByRange("idx").sortWithinPartitions("idx")
     .select(F.concat(start, "text", end)).write.mode(mode).text(path))


def timeframes_csv_rows(report: DataFrame) -> DataFrame:
    """SNK-4: flat timeframe rows as CSV would hold them."""
    return report.select("ordinal", "period_start", "period_end", "duration_seconds",
                         "confidence_pct", "apis_shown", "identities_shown", "n_identities")


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK-7 for JSON: the ``json`` column as text lines."""
    df.select("json").write.mode(mode).text(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK-7 for CSV."""
    df.write.mode(mode).option("header", "true").csv(path)


def write_section(result, section: str, fmt: str, path: str) -> None:
    """SNK-7: write one section (clusters / suspicious / timeframes) of a ``Detection``."""
    if fmt == "document":
        if section == "clusters":
            write_json_document(clusters_pieces(result.profile), "clusters", path)
        elif section == "suspicious":  # one line is the document
            write_json_lines(suspicious_json(result.summary), path)
        elif section == "timeframes":
            write_json_document(timeframes_pieces(result.timeframes, result.apis, result.identities),
                                "suspicious_timeframes", path)
        else:
            raise ValueError(f"unknown section {section!r}")
    elif fmt == "json":
        if section == "clusters":
            write_json_lines(clusters_json_lines(result.profile), path)
        elif section == "suspicious":
            write_json_lines(suspicious_json(result.summary), path)
        elif section == "timeframes":
            write_json_lines(timeframes_json_lines(result.timeframes, result.apis,
                                                   result.identities), path)
        else:
            raise ValueError(f"unknown section {section!r}")
    elif fmt == "csv":
        frames = {"clusters": result.profile.withColumn(
                      "event_names", F.array_join("event_names", ";")),
                  "suspicious": result.summary.withColumn(
                      "suspicious_clusters", F.array_join(
                          F.col("suspicious_clusters").cast("array<string>"), ";")),
                  "timeframes": timeframes_csv_rows(result.report)}
        if section not in frames:
            raise ValueError(f"unknown section {section!r}")
        write_csv(frames[section], path)
    else:
        raise ValueError(f"unknown output format {fmt!r}")
