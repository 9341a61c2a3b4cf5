"""Spark-first analytics for long-format water-quality measurements."""
