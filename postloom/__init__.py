"""Posting-event analytics on Spark: pure DataFrame -> DataFrame operators."""
