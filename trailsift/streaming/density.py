"""Rolling suspicious-call density, and the timeframes it forms, over a stream of audit events
(ML-5, WIN-3/4/5 incrementally).

The batch job's trailing sum over (t - window, t] is exactly a sliding event-time
window of ``window`` minutes sliding by 1 minute, labelled by ``end - 1 minute``.
With a watermark, each window is emitted once (append mode) when it can no
longer change; events later than the watermark are dropped, which the batch
form never does. State is bounded by the watermark span times the window.

Where the batch job stops at the last event minute, the stream also emits the
minutes up to ``window - 1`` after it (their trailing sums are still exact).

A timeframe is a session of dense minutes, whose gap is longer than one minute and shorter than two. It is
emitted once, when the watermark shows that no dense minute can join it any more; a run that is still open
stays in the state, as one row per run, however long it is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailsift.functions.scalars import safe_ratio


#: A session ends when the next minute is not dense: more than one minute, less than two.
GAP_SECONDS = 90


def _windows(events: DataFrame, flag: str | Column, window_minutes: int, watermark: str, time_col: str,
             keys: Sequence[str] = ()) -> DataFrame:
    """(keys, window, roll_total, roll_susp, density) of every closed trailing window."""
    flag_col = F.col(flag) if isinstance(flag, str) else flag
    return (events.withWatermark(time_col, watermark)
            .groupBy(*keys, F.window(time_col, f"{window_minutes} minutes", "1 minute"))
            .agg(F.count("eventName").alias("roll_total"),
                 F.count(F.when(flag_col, F.col("eventName"))).alias("roll_susp"))
            .withColumn("density", safe_ratio("roll_susp", "roll_total")))


def streaming_density(events: DataFrame, flag: str | Column, window_minutes: int = 60,
                      watermark: str = "10 minutes", time_col: str = "eventTime") -> DataFrame:
    """(minute, roll_total, roll_susp, density) per closed trailing window of a streaming frame."""
    return _windows(events, flag, window_minutes, watermark, time_col).select(
        (F.col("window.end") - F.expr("INTERVAL 1 MINUTE")).alias("minute"), "roll_total", "roll_susp", "density")


def streaming_timeframe_minutes(events: DataFrame, flag: str | Column, window_minutes: int = 60,
                                density_threshold: float = 0.10,
                                watermark: str = "10 minutes") -> DataFrame:
    """Minutes at or above the density threshold, as they close (input to the island merge)."""
    dens = streaming_density(events, flag, window_minutes, watermark)
    return dens.filter(F.col("density") >= F.lit(density_threshold))


def streaming_timeframes(events: DataFrame, flag: str | Column, window_minutes: int = 60,
                         density_threshold: float = 0.10, watermark: str = "10 minutes",
                         time_col: str = "eventTime", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, tf_start, tf_end, confidence) of each timeframe, once it is closed (append mode).

    With ``keys`` (an account, say) every key has timeframes of its own; rows with a null key form one
    too. On what the watermark has let through, the result is that of
    ``operators.timeframes.detect_timeframes`` less the run that is open at the end. ``density_threshold`` must be
    above 0, since minutes without events are no rows of a stream.
    """
    if density_threshold <= 0:
        raise ValueError("density_threshold must be above 0 on a stream")
    dense = _windows(events, flag, window_minutes, watermark, time_col, keys).filter(
        F.col("density") >= F.lit(density_threshold))
    # The window's last microsecond carries the watermark on to the sessions. A streaming session needs a key beside it.
    minutes = dense.select(*keys, F.window_time("window").alias("closes"), "density",
                           F.when(F.col("density").isNotNull(), F.lit(0)).alias("__all"))
    sessions = minutes.groupBy(*keys, "__all", F.session_window("closes", f"{GAP_SECONDS} seconds").alias("run")).agg(
        F.max("density").alias("confidence"))
    tick = F.expr("INTERVAL 0.000001 SECOND")
    return sessions.select(
        *keys, (F.col("run.start") + tick - F.expr("INTERVAL 1 MINUTE")).alias("tf_start"),
        (F.col("run.end") + tick - F.expr(f"INTERVAL {GAP_SECONDS} SECOND")).alias("tf_end"), "confidence")
