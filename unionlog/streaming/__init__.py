"""Continuous ingest: distinct elements and per-observation statuses over unbounded input."""

from unionlog.streaming.ingest import distinct_stream, drain, finish_aware_writer, status_stream  # noqa: F401
