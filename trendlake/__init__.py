"""Trend analytics on Spark: extraction, ordered dedup, noise filter, scoring and keyed upsert."""
