"""Structured Streaming form of the bucketed aggregation."""

from sparkseries.streaming.resample import resample_stream, start_resample_stream

__all__ = ["resample_stream", "start_resample_stream"]
