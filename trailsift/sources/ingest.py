"""File ingest of audit logs (SRC-1, SRC-2, SRC-3, SRC-5, SRC-7, SRC-10).

Spark lists and reads the files: all arguments are one ``binaryFile`` read (``listing``), so names with
spaces, ``%`` or glob characters need no encoding of their own, and a damaged compressed file is a
row of ``bad_files`` instead of a failed job. Files are numbered by a distributed index over
(argument, match, name); names that Spark's readers never list (leading ``_`` or ``.``) are
reported in ``bad_files`` too, so that events and bad files together account for every
listed file. A file of more than ``large`` bytes is no row: its byte ranges are read in parallel
(``ranges``), with the same records as result.

For repeated analysis, land the result once as Parquet (``land_as_parquet``): rows are range
partitioned by date and time, and carry ``is_readonly`` and ``service`` as typed columns
that filters push to the scan.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from trailsift.functions.scalars import is_readonly, strip_service
from trailsift.operators.components import dense_index
from trailsift.session import literal_table, materialize
from trailsift.sources.envelopes import is_envelope, records_from_envelopes, typed_records
from trailsift.sources.listing import Listing
from trailsift.sources.ranges import split_envelopes
from trailsift.sources.schema import AUDIT_COLUMNS

#: Indexes of more files than this are joined by shuffle instead of broadcast.
BROADCAST_FILES = 200_000
#: Files of more bytes are read by ranges instead of as one row.
LARGE_FILE = 64 << 20
#: Bytes that a row can hold; compressed files can't be read by ranges.
ROW_LIMIT = (1 << 31) - 1


@dataclass
class Ingested:
    events: DataFrame       # AUDIT_COLUMNS + src_file, src_pos
    bad_files: DataFrame    # file, reason: files that gave no envelope, once each
    files: DataFrame        # file, file_no, from_dir: the files read, numbered in order

    def absent(self, *fields: str) -> set[str]:
        """Those of ``fields`` that no record has as a key (one aggregation over the records)."""
        keys = F.json_object_keys("raw")
        row = self.events.agg(*[F.bool_or(F.array_contains(keys, f)).alias(f) for f in fields]).first()
        return {f for f in fields if not row[f]}

    def schema(self) -> str:
        """SRC-8: the schema that the records themselves have, merged over all of them (one aggregation)."""
        return self.events.agg(F.schema_of_variant_agg(F.try_parse_json("raw"))).first()[0]


@F.pandas_udf(StringType())
def _unpacked(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Text of gzip files; null where a file is damaged."""
    def text(content):
        try:
            return gzip.decompress(content).decode("utf-8", "replace")
        except (OSError, EOFError, zlib.error):
            return None
    for part in parts:
        yield part.map(text, na_action="ignore")


def read_audit_logs(spark: SparkSession, patterns: list[str] | str, large: int = LARGE_FILE) -> Ingested:
    """Read audit-log files and directories into the audit-event table.

    Files named directly keep every record; files found by a directory scan keep only objects
    with an ``eventName`` key. No input at all gives empty tables.
    """
    if isinstance(patterns, str):
        patterns = [patterns]
    listing = Listing(spark, patterns)
    skipped = spark.createDataFrame(pa.table({"file": pa.array(sorted(listing.hidden), pa.string())})).withColumn(
        "reason", F.lit("hidden name, not listed by Spark"))
    if not listing.arguments:
        empty = literal_table(spark, [], "file STRING, file_no LONG, value STRING, from_dir BOOLEAN")
        return Ingested(records_from_envelopes(empty, require_event_name=F.col("from_dir")),
                        skipped, empty.select("file", "file_no", "from_dir"))
    # Numbers in (argument, match, name) order; only names are read for it.
    index = dense_index(listing.files(), ["arg", "matched", "file"], "file_no")
    index = materialize(index.select("file", "length", "from_dir", F.col("file_no").cast("long").alias("file_no")),
                        "ingest-files")
    packed = F.lower("file").endswith(".gz")
    by_range = ~packed & (F.col("length") > large)
    facts = index.agg(F.count(F.lit(1)).alias("n"), F.bool_or(packed).alias("packed"),
                      F.bool_or(by_range).alias("large")).first()

    def numbered(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(index) if facts["n"] <= BROADCAST_FILES else index, "file").drop("length")

    # File sizes and names are known before a file is opened: these filters prune files.
    rows = listing.read("binaryFile").filter((F.col("_metadata.file_size") <= large)
                                             | F.lower("_metadata.file_name").endswith(".gz"))
    rows = numbered(rows.filter(F.col("length") <= ROW_LIMIT).select(F.col("path").alias("file"), "content"))
    # Spark decodes plain files; only packed ones pass through Python.
    texts = rows.filter(~packed).withColumn("value", F.decode("content", "UTF-8"))
    if facts["packed"]:
        texts = texts.unionByName(rows.filter(packed).withColumn("value", _unpacked("content")))
    events = records_from_envelopes(texts, require_event_name=F.col("from_dir"))
    bad = texts.filter(~is_envelope("value")).select("file", _reason(F.col("value")).alias("reason"))
    too_large = index.filter(packed & (F.col("length") > ROW_LIMIT)).select(
        "file", F.lit("compressed file too large for a row").alias("reason"))
    if facts["large"]:
        fragments = listing.read("text", lineSep="}").filter(
            (F.col("_metadata.file_size") > large) & ~F.lower("_metadata.file_name").endswith(".gz"))
        records, broken = split_envelopes(fragments.select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("start"),
            F.make_valid_utf8("value").alias("value")))
        # Paths come encoded; a record's is decoded here, not that of each of its fragments.
        name = F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B")))
        records, broken = records.withColumn("file", name), broken.withColumn("file", name)
        cut = numbered(records).select(F.col("file").alias("src_file"), F.col("file_no").alias("__file_no"),
                                       F.col("from_dir").alias("__require"), "src_pos", F.col("text").alias("raw"))
        events = events.unionByName(typed_records(cut))
        named = index.filter(by_range).join(broken, "file", "left_semi")
        bad = bad.unionByName(named.select("file", _reason(F.col("file")).alias("reason")))
    return Ingested(events=events, bad_files=bad.unionByName(too_large).unionByName(skipped).distinct(),
                    files=index.select("file", "file_no", "from_dir"))


def _reason(value: Column) -> Column:
    return F.when(value.isNull(), F.lit("damaged compressed file")).otherwise(F.lit("no JSON object or list"))


def land_as_parquet(events: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write the audit table for pruned re-reads.

    Rows are range partitioned and sorted by (date, time), so a date has few files and row groups
    hold narrow time ranges; ``is_readonly`` and ``service`` are what the filters test.
    """
    (events.select(*AUDIT_COLUMNS, is_readonly("readOnly").alias("is_readonly"),
                   strip_service("eventSource").alias("service"), F.to_date("eventTime").alias("event_date"))
     .repartitionByRange("event_date", "eventTime").sortWithinPartitions("event_date", "eventTime")
     .write.mode(mode).partitionBy("event_date").parquet(path))


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """Read a table written by ``land_as_parquet`` (time filters prune its date partitions)."""
    return spark.read.parquet(path)
