"""Audit-log envelopes: ``{"Records": [...]}`` or a top-level list of records.

``records_from_envelopes`` is the unwrap used by file ingest (SRC-2, SRC-4,
SRC-6, SRC-8, SRC-9): one row per record with the raw record text, typed
top-level fields, and polymorphic fields kept as JSON text.
``envelopes_from_events`` goes the other way, so that the unwrap can be
checked on the given tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailsift.sources.schema import AUDIT_COLUMNS, JSON_FIELDS, STRING_FIELDS

_RECORD_SCHEMA = ", ".join(f"`{n}` STRING" for n in ["eventTime", *STRING_FIELDS, *JSON_FIELDS])


def _json_text(field: str) -> Column:
    """The field as JSON text: objects/arrays/numbers as written, strings re-quoted.

    ``from_json`` with a STRING field hands back a JSON string without its quotes;
    the variant type of the same field tells such strings apart.
    """
    plain = F.col("__rec").getField(field)
    kind = F.schema_of_variant(F.variant_get(F.col("__var"), f"$.{field}", "variant"))
    quoted = F.regexp_replace(F.regexp_replace(F.to_json(F.array(plain)), r"^\[", ""), r"\]$", "")
    return F.when(kind == "STRING", quoted).otherwise(plain)


def records_from_envelopes(envelopes: DataFrame, value_col: str = "value", file_col: str = "file",
                           require_event_name: bool | Column = False) -> DataFrame:
    """Unwrap envelope texts to audit rows.

    Output: ``AUDIT_COLUMNS`` (``event_id`` = file order x 2^32 + position when a
    ``file_no`` column is present, else position) plus ``src_file``/``src_pos``.
    ``require_event_name`` keeps only objects that have the key ``eventName``
    (directory scans, SRC-6); it may be a boolean column per file.
    """
    value = F.col(value_col)
    recs = F.coalesce(F.from_json(value, "struct<Records: array<string>>").getField("Records"),
                      F.from_json(value, "array<string>"))
    file_no = F.col("file_no") if "file_no" in envelopes.columns else F.lit(0).cast("long")
    rows = envelopes.select(F.col(file_col).alias("src_file"), file_no.alias("__file_no"),
                            F.lit(require_event_name).alias("__require")
                            if isinstance(require_event_name, bool) else
                            require_event_name.alias("__require"),
                            F.posexplode(recs).alias("src_pos", "raw"))
    return typed_records(rows)


def typed_records(rows: DataFrame) -> DataFrame:
    """Typed audit rows of record texts (src_file, __file_no, __require, src_pos, raw)."""
    keys = F.json_object_keys("raw")
    is_object = keys.isNotNull()
    has_name = F.coalesce(F.array_contains(keys, "eventName"), F.lit(False))
    rows = rows.filter(~F.col("__require") | (is_object & has_name))
    parsed = rows.select("*", F.from_json("raw", _RECORD_SCHEMA).alias("__rec"),
                         F.try_parse_json("raw").alias("__var"))
    cols = {
        "event_id": (F.col("__file_no") * F.lit(2**32) + F.col("src_pos")).cast("long"),
        "eventTime": F.try_to_timestamp(F.col("__rec").getField("eventTime")),
        "raw": F.col("raw"),
    }
    for name in STRING_FIELDS:
        cols[name] = F.col("__rec").getField(name)
    for name in JSON_FIELDS:
        cols[name] = _json_text(name)
    return parsed.select(*[cols[c].alias(c) for c in AUDIT_COLUMNS], "src_file", "src_pos")


def is_envelope(value_col: str = "value") -> Column:
    """SRC-5: whether a text is a JSON object or array (not malformed or truncated, not null).

    ``json_object_keys`` / ``json_array_length`` parse the whole text and give
    NULL when it is not valid JSON of that shape.
    """
    value = F.col(value_col)
    return F.coalesce(F.json_object_keys(value).isNotNull() | F.json_array_length(value).isNotNull(),
                      F.lit(False))


def _record_json(events: DataFrame, drop_null_keys: list[str]) -> Column:
    """One CloudTrail-style record per event; JSON-text fields are embedded as JSON."""
    fields = [F.col("event_id").cast("string").alias("eventID"),
              F.date_format("eventTime", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("eventTime")]
    for name in AUDIT_COLUMNS[2:]:
        if name == "raw":
            continue
        if name in JSON_FIELDS:
            fields.append(F.try_parse_json(F.col(name)).alias(name))
        elif name == "readOnly":
            fields.append((F.lower(F.col(name)) == "true").alias(name))
        else:
            fields.append(F.col(name).alias(name))
    text = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    for key in drop_null_keys:
        text = F.regexp_replace(text, f',"{key}":null', "")
    return text


def envelopes_from_events(events: DataFrame, records_per_file: int = 50,
                          drop_null_keys: list[str] | None = None) -> DataFrame:
    """Wrap audit events into envelopes of at most ``records_per_file`` records.

    Files are keyed by ``event_id div records_per_file`` (a proven bound on the
    group size); every other file uses the top-level-list shape. Keys listed in
    ``drop_null_keys`` are left out of a record when their value is null.
    """
    rec = events.select((F.col("event_id") / records_per_file).cast("long").alias("file_no"),
                        "event_id", _record_json(events, drop_null_keys or []).alias("rec"))
    grouped = rec.groupBy("file_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "rec"))),
                                 lambda s: s.getField("rec")), ",").alias("body"))
    value = F.when(F.col("file_no") % 2 == 0,
                   F.concat(F.lit('{"Records":['), F.col("body"), F.lit("]}"))) \
        .otherwise(F.concat(F.lit("["), F.col("body"), F.lit("]")))
    return grouped.select(F.format_string("envelope-%08d.json", "file_no").alias("file"),
                          "file_no", value.alias("value"))
