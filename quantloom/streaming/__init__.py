"""Incremental forms of the batch operators as Structured Streaming jobs."""
