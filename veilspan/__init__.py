"""Spark-first analytics for sensitive text: find, resolve, rewrite and report spans."""
