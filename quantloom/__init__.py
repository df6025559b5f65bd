"""Equity-research analytics expressed as Spark DataFrame, SQL, ML and Structured Streaming jobs."""
