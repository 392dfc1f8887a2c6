"""Extension beyond the batch engine: the same operators over streams."""
