"""Incremental forms of the timeframe stage for Structured Streaming."""

from trailsift.streaming.density import streaming_density, streaming_timeframe_minutes, streaming_timeframes

__all__ = ["streaming_density", "streaming_timeframe_minutes", "streaming_timeframes"]
