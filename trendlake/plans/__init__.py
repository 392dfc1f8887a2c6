"""Compositions: the post pipeline and the keyword pipeline."""
