"""Operators of a large-scale training-data pipeline, as Spark jobs.

Nothing outside this subpackage imports it; the query registry of the repository adds its
queries only when the subpackage is present.
"""
