"""Operators for building training data at scale.

The rest of the library does not import this subpackage; it can be deleted.
"""
