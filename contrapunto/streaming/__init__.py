"""Structured Streaming forms of the log, progress and snapshot jobs."""
