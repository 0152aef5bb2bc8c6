"""Structured Streaming variants of the scoring and metering jobs."""
