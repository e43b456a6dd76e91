"""The audit-event table every operator works on (declared, never inferred)."""

from __future__ import annotations

from pyspark.sql import types as T

# The field names of the log format.
# Top-level record keys kept as typed columns. Polymorphic fields are JSON text.
STRING_FIELDS = [
    "eventName", "eventSource", "eventCategory", "eventType", "recipientAccountId",
    "awsRegion", "sourceIPAddress", "userAgent", "errorCode", "readOnly",
]
JSON_FIELDS = ["userIdentity", "sessionContext", "requestParameters", "responseElements"]

AUDIT_COLUMNS = [
    "event_id", "eventTime", "eventName", "eventSource", "eventCategory", "eventType",
    "userIdentity", "sessionContext", "recipientAccountId", "awsRegion", "sourceIPAddress",
    "userAgent", "errorCode", "requestParameters", "responseElements", "readOnly", "raw",
]


def audit_schema(time_type: T.DataType = T.TimestampType()) -> T.StructType:
    fields = [T.StructField("event_id", T.LongType()), T.StructField("eventTime", time_type)]
    for name in AUDIT_COLUMNS[2:]:
        fields.append(T.StructField(name, T.StringType()))
    return T.StructType(fields)
