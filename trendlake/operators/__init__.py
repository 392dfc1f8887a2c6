"""DataFrame operators: ordered dedup, limits, caps, union, ranking, keyed upsert."""
