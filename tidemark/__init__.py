"""Trend analytics over daily price series, expressed as Spark DataFrame operators."""
