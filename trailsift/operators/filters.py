"""Row filters (FLT-1, FLT-2, FLT-3). All narrow, all pushed to the scan when they can be."""

from __future__ import annotations

import datetime as dt
from collections.abc import Collection, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailsift.functions.scalars import is_readonly, strip_service


def parse_bound(text: str | None) -> dt.datetime | None:
    """Parse a bound, in any form that pandas reads, to a naive UTC datetime; raise ValueError otherwise."""
    if text is None:
        raise ValueError("no bound")
    value = pd.to_datetime(str(text).strip(), utc=True)
    if pd.isna(value):
        raise ValueError(f"no time: {text!r}")
    return value.to_pydatetime(warn=False).replace(tzinfo=None)


def _bound_literal(value: dt.datetime, data_type: T.DataType) -> Column:
    text = value.isoformat(sep=" ")
    if isinstance(data_type, T.TimestampNTZType):
        return F.lit(text).cast("timestamp_ntz")
    return F.lit(text + "+00:00").cast("timestamp")


def filter_by_time(df: DataFrame, start_time: str | None = None, end_time: str | None = None,
                   time_col: str = "eventTime", absent: Collection[str] = ()) -> DataFrame:
    """FLT-1: keep ``start <= eventTime <= end``.

    Empty/None bounds mean no bound. If either given bound does not parse, the
    whole filter is dropped (the input comes back unchanged). Zone-less bounds
    are read as UTC. Null times fail any bound. ``absent`` names the fields that no
    record has (``Ingested.absent``); without any time nothing is filtered.
    """
    if not start_time and not end_time:
        return df
    if time_col not in df.columns or time_col in absent:
        return df
    try:
        start = parse_bound(start_time) if start_time else None
        end = parse_bound(end_time) if end_time else None
    except (ValueError, TypeError, OverflowError):
        return df
    data_type = df.schema[time_col].dataType
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col(time_col) >= _bound_literal(start, data_type))
    if end is not None:
        cond = cond & (F.col(time_col) <= _bound_literal(end, data_type))
    if "event_date" in df.columns:
        # A table landed by ``land_as_parquet``: the same bounds on the partition column
        # let the scan skip whole date directories.
        if start is not None:
            cond = cond & (F.col("event_date") >= F.lit(start.date().isoformat()).cast("date"))
        if end is not None:
            cond = cond & (F.col("event_date") <= F.lit(end.date().isoformat()).cast("date"))
    return df.filter(cond)


def filter_by_services(df: DataFrame, services: Sequence[str | None] | None,
                       absent: Collection[str] = ()) -> DataFrame:
    """FLT-2: keep events whose source minus '.amazonaws.com' is one of ``services`` (exact).

    A landed table's ``service`` column is tested as it stands, which the scan can push down.
    """
    if not services:
        return df
    if "eventSource" not in df.columns or "eventSource" in absent:
        return df
    wanted = [s for s in services if s is not None]
    if not wanted:
        return df.filter(F.lit(False))
    service = F.col("service") if "service" in df.columns else strip_service("eventSource")
    return df.filter(service.isin(*wanted))


def filter_readonly(df: DataFrame, on_missing: str = "keep", absent: Collection[str] = ()) -> DataFrame:
    """FLT-3: keep read-only events (boolean true or 'true','1','t','yes','y', any case).

    Without a ``readOnly`` column, or where no record has the field (``absent``), every row is
    kept (``on_missing='keep'``). A landed table's ``is_readonly`` is tested as it stands.
    """
    if "readOnly" not in df.columns or "readOnly" in absent:
        return df if on_missing == "keep" else df.filter(F.lit(False))
    return df.filter(F.col("is_readonly") if "is_readonly" in df.columns else is_readonly("readOnly"))
