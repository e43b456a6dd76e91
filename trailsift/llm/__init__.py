"""Operators of a training-data pipeline: language ID, near-dedup, mixing, packing, scoring, filters.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries
only when it can be imported.
"""
