"""Column functions: text and URL rules, counts, scores."""
