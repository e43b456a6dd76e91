"""Dense-activity timeframes (ML-5, ML-6; AGG-8..12, WIN-1..5, JOIN-3).

Plan, with no dense minute spine and no one-partition window over events:

1. ``minute_counts``: one ``groupBy(minute)`` over the events -> (minute, total,
   susp). Its size is bounded by the time span (<= 525,600 rows a year), not by
   the event count; it is materialised once because every later step reads it.
2. ``rolling_density``: each minute is exploded to the ``window`` minutes it
   contributes to, then grouped -> trailing sums over (t - window, t].
3. ``islands``: flagged minutes merged within days, then the runs that touch midnight
   over days; ``end`` is the first minute after the run, or the last minute when the run is
   still open. Input is flagged minutes only.
4. ``timeframe_events``: interval join of suspicious events to timeframes,
   equi-join on an hour bucket plus the exact range predicate.
"""

from __future__ import annotations

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailsift.functions import scalars as S
from trailsift.session import materialize

HOUR_MICROS = 3_600_000_000
#: Join keys that the events of one hour are dealt to.
HOUR_SHARES = 32
#: Added to minute numbers so that none is negative (whole days, beyond the year 1); more minutes than any series has.
MINUTES_TO_ZERO, ALL_MINUTES = 1440 << 20, 1440 << 30


def _minute(c: str | Column) -> Column:
    """Start of the minute, keeping the input's timestamp type (WIN-1)."""
    return F.window(c, "1 minute").start


def minute_counts(events: DataFrame, flag: str | Column | None = None,
                  time_col: str = "eventTime") -> DataFrame:
    """AGG-8 / JOIN-1: per minute, non-null ``eventName`` counts, all and flagged.

    ``flag`` marks suspicious rows (boolean column or expression).
    """
    flag_col = F.lit(False) if flag is None else (F.col(flag) if isinstance(flag, str) else flag)
    return (events.filter(F.col(time_col).isNotNull())
            .groupBy(_minute(time_col).alias("minute"))
            .agg(F.count("eventName").alias("total"),
                 F.count(F.when(flag_col, F.col("eventName"))).alias("susp")))


def last_minute_literal(minutes: DataFrame) -> Column | None:
    """The last minute of the series as a typed literal (None when empty)."""
    dtype = minutes.schema["minute"].dataType.simpleString()
    text = minutes.agg(F.max("minute").cast("string")).first()[0]
    return None if text is None else F.lit(text).cast(dtype)


def minute_spine(minutes: DataFrame) -> DataFrame:
    """WIN-2: every minute from the first to the last, zero-filled."""
    bounds = minutes.agg(F.min("minute").alias("lo"), F.max("minute").alias("hi"))
    spine = bounds.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 MINUTE")))
                          .alias("minute"))
    spine = spine.select(F.col("minute").cast(minutes.schema["minute"].dataType).alias("minute"))
    return (spine.join(minutes, "minute", "left")
            .select("minute", F.coalesce("total", F.lit(0)).alias("total"),
                    F.coalesce("susp", F.lit(0)).alias("susp")))


def rolling_density(minutes: DataFrame, window_minutes: int = 60,
                    last_minute: Column | None = None) -> DataFrame:
    """WIN-3 / WIN-4: trailing sums over the current minute and the ``window-1`` before.

    Only minutes with at least one event in their window appear; the others have
    density 0. ``last_minute`` drops windows that end after the series does.
    """
    spread = minutes.select(
        "minute", "total", "susp",
        F.explode(F.sequence(F.lit(0), F.lit(window_minutes - 1))).alias("off"))
    spread = spread.select(
        "total", "susp", (F.col("minute") + F.make_dt_interval(mins=F.col("off"))).alias("minute"))
    if last_minute is not None:
        spread = spread.filter(F.col("minute") <= last_minute)
    rolled = spread.groupBy("minute").agg(F.sum("total").alias("roll_total"),
                                          F.sum("susp").alias("roll_susp"))
    return rolled.withColumn("density", S.safe_ratio("roll_susp", "roll_total"))


def dense_density(minutes: DataFrame, window_minutes: int = 60) -> DataFrame:
    """Rolling density on the dense spine (needed only when the threshold is <= 0)."""
    spine = minute_spine(minutes)
    rolled = rolling_density(minutes, window_minutes)
    return (spine.select("minute").join(rolled, "minute", "left")
            .select("minute", F.coalesce("roll_total", F.lit(0)).alias("roll_total"),
                    F.coalesce("roll_susp", F.lit(0)).alias("roll_susp"),
                    F.coalesce("density", F.lit(0.0)).alias("density")))


def _merged(runs: DataFrame, minutes: int) -> DataFrame:
    """Runs (first, last as minute numbers; tf_start, last_flagged, confidence) that follow each other without
    a gap become one, within buckets of ``minutes``; adds whether a run touches an end of its bucket."""
    bucket = F.floor(F.col("first") / minutes)
    order = Window.partitionBy("bucket").orderBy("first")
    begins = F.coalesce(F.col("first") > F.lag("last").over(order) + 1, F.lit(True)).cast("long")
    merged = (runs.withColumn("bucket", bucket).withColumn("begins", begins)
              .withColumn("run", F.sum("begins").over(order)).groupBy("bucket", "run").agg(
                  *[F.min(c).alias(c) for c in ("first", "tf_start")],
                  *[F.max(c).alias(c) for c in ("last", "last_flagged", "confidence")]))
    return merged.withColumn("open", (F.col("first") % minutes == 0) | (F.col("last") % minutes == minutes - 1))


def islands(density: DataFrame, threshold: float, last_minute: Column) -> DataFrame:
    """FLT-8 + WIN-5 + AGG-9: runs of minutes with density >= threshold.

    Runs form within days, each day by itself; only those that touch midnight (two a day at most) meet
    once more, to be joined over the days they cross.
    """
    flagged = density.filter(F.col("density") >= F.lit(threshold))
    micros = F.unix_micros(F.col("minute").cast("timestamp"))
    number = F.floor(micros / F.lit(60_000_000)).cast("long") + F.lit(MINUTES_TO_ZERO)
    daily = _merged(flagged.select(number.alias("first"), number.alias("last"), F.col("minute").alias("tf_start"),
                                   F.col("minute").alias("last_flagged"), F.col("density").alias("confidence")), 1440)
    names = ["tf_start", "last_flagged", "confidence"]
    whole = daily.filter(~F.col("open")).select(*names)
    crossing = _merged(daily.filter("open").drop("bucket", "run", "open"), ALL_MINUTES).select(*names)
    return whole.unionByName(crossing).select(
        "tf_start",
        F.least(F.col("last_flagged") + F.expr("INTERVAL 1 MINUTE"), last_minute).alias("tf_end"),
        "confidence")


def detect_timeframes(events: DataFrame, flag: str | Column | None, window_minutes: int = 60,
                      density_threshold: float = 0.10, time_col: str = "eventTime") -> DataFrame:
    """ML-5: (tf_start, tf_end, confidence) for the events' suspicious ``flag``."""
    # The last minute is observed while the minute series is written (after its
    # aggregation, so once per partition); no separate job reads it back.
    obs = Observation()
    counts = minute_counts(events, flag, time_col)
    minutes = materialize(counts.observe(obs, F.max("minute").cast("string").alias("last")))
    try:
        text = obs.get["last"]
        last = None if text is None else F.lit(text).cast(
            minutes.schema["minute"].dataType.simpleString())
    except Py4JError:
        # No metrics when the optimiser proved the input empty and dropped the scan.
        last = last_minute_literal(minutes)
    if last is None:
        return minutes.select(F.col("minute").alias("tf_start"), F.col("minute").alias("tf_end"),
                              F.lit(0.0).alias("confidence")).limit(0)
    if density_threshold <= 0:
        density = dense_density(minutes, window_minutes)
    else:
        density = rolling_density(minutes, window_minutes, last)
    return islands(density, density_threshold, last)


def _hour_no(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.floor(F.unix_micros(col.cast("timestamp")) / F.lit(HOUR_MICROS)).cast("bigint")


def timeframe_events(timeframes: DataFrame, suspicious: DataFrame,
                     time_col: str = "eventTime") -> DataFrame:
    """JOIN-3 / FLT-7: suspicious events with ``tf_start <= t <= tf_end``.

    Equi-join on the hour bucket (timeframes exploded to the hours they cover,
    a set bounded by the time span), then the exact range predicate. The events of an hour are dealt to
    HOUR_SHARES keys by a hash, and every hour of a timeframe stands under all of them, so that an hour with
    most of the events is no single task's. AQE turns it into a broadcast join when the timeframe side is
    small at run time.
    """
    tf_hours = timeframes.select(
        "tf_start", "tf_end", "confidence",
        F.explode(F.sequence(_hour_no("tf_start"), _hour_no("tf_end"))).alias("hour_no")).withColumn(
        "hour_share", F.explode(F.sequence(F.lit(0), F.lit(HOUR_SHARES - 1))))
    dealt = [time_col, *(c for c in ("event_id", "eventName", "sourceIPAddress") if c in suspicious.columns)]
    ev = suspicious.withColumns({"hour_no": _hour_no(time_col),
                                 "hour_share": F.pmod(F.xxhash64(*dealt), F.lit(HOUR_SHARES)).cast("int")})
    joined = ev.join(tf_hours, ["hour_no", "hour_share"], "inner").filter(
        (F.col(time_col) >= F.col("tf_start")) & (F.col(time_col) <= F.col("tf_end")))
    return joined.drop("hour_no", "hour_share")


def identity_columns(time_col: str = "eventTime") -> list[Column]:
    """PRJ-4: (ip, iam, user_agent, os) of an event."""
    return [S.safe_str("sourceIPAddress").alias("ip"),
            S.iam_name("userIdentity").alias("iam"),
            S.safe_str("userAgent").alias("user_agent"),
            S.guess_os("userAgent").alias("os")]


def timeframe_identities(tf_events: DataFrame, order_col: str = "event_id") -> DataFrame:
    """AGG-10 in long form: one identity row per suspicious event of each timeframe.

    The reference keeps every tuple, duplicates included, in input order; here
    that list is a table keyed by (tf_start, ord) instead of one unbounded array.
    """
    return tf_events.select("tf_start", F.col(order_col).alias("ord"), *identity_columns())


def timeframe_identities_distinct(tf_events: DataFrame) -> DataFrame:
    """AGG-10 variant: each distinct identity of a timeframe with its number of events
    and the input position of its first event (map-side combined, skew-safe)."""
    return (tf_events.select("tf_start", F.col("event_id").alias("ord"), *identity_columns())
            .groupBy("tf_start", "ip", "iam", "user_agent", "os")
            .agg(F.count(F.lit(1)).alias("n_events"), F.min("ord").alias("first_ord")))


def timeframe_apis(tf_events: DataFrame) -> DataFrame:
    """AGG-11: sorted distinct API names per timeframe (bounded by the API vocabulary)."""
    return tf_events.groupBy("tf_start").agg(
        F.array_sort(F.collect_set(S.safe_str("eventName"))).alias("example_apis"),
        F.count(F.lit(1)).alias("n_identities"))


def first_identities(identities: DataFrame, k: int = 5) -> DataFrame:
    """TOP-3: the first ``k`` identities per timeframe by input order.

    Spark keeps the first ``k`` of each timeframe in every task before the shuffle
    (WindowGroupLimit), so one huge timeframe never lands in one task.
    """
    w = Window.partitionBy("tf_start").orderBy("ord")
    return identities.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k)


def grouped_by_prefix(arr: Column) -> Column:
    """AGG-12 on an array of names: 'prefix: a, b | prefix2: c', prefixes in first-seen order."""
    prefix = S.name_prefix
    prefixes = F.array_distinct(F.transform(arr, prefix))
    parts = F.transform(prefixes, lambda p: F.concat(
        p, F.lit(": "), F.array_join(F.filter(arr, lambda x: prefix(x) == p), ", ")))
    return F.array_join(parts, " | ")


def timeframe_report(timeframes: DataFrame, tf_events: DataFrame, max_apis: int = 15,
                     max_identities: int = 5) -> DataFrame:
    """SNK-6 (data part): one row per timeframe with display-ready fields.

    ``timeframes`` is read several times: pass a written table. The ordinal is given to the bare
    timeframes (three small columns), before any text is joined to them.
    """
    apis = timeframe_apis(tf_events)
    firsts = first_identities(timeframe_identities(tf_events), max_identities)
    ident_text = firsts.select(
        "tf_start", "pos",
        F.concat_ws(" / ", "ip", "iam", S.strip_brackets("user_agent"), "os").alias("txt"))
    ident_agg = ident_text.groupBy("tf_start").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "txt"))),
                                 lambda s: s.getField("txt")), " || ").alias("identities_shown"))
    numbered = timeframes.withColumn("ordinal", F.row_number().over(Window.orderBy("tf_start")))
    return (numbered.join(apis, "tf_start", "left").join(ident_agg, "tf_start", "left")
            .select(
               "ordinal", "tf_start", "tf_end",
               S.utc_time("tf_start").alias("period_start"),
               S.utc_time("tf_end").alias("period_end"),
               ((F.unix_micros(F.col("tf_end").cast("timestamp"))
                 - F.unix_micros(F.col("tf_start").cast("timestamp"))) / 1_000_000)
               .cast("bigint").alias("duration_seconds"),
               F.round(F.col("confidence") * 100, 1).alias("confidence_pct"),
               F.coalesce(F.size("example_apis"), F.lit(0)).alias("n_apis"),
               F.coalesce(grouped_by_prefix(F.slice(F.coalesce(
                   "example_apis", F.array().cast("array<string>")), 1, max_apis)),
                   F.lit("")).alias("apis_shown"),
               F.coalesce("identities_shown", F.lit("")).alias("identities_shown"),
               F.coalesce("n_identities", F.lit(0)).alias("n_identities"),
               F.greatest(F.coalesce("n_identities", F.lit(0)) - max_identities, F.lit(0))
               .alias("more_identities")))
