"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it.  ``queries.QUERIES`` and
``queries.ORACLES`` list what ``__spark_entry__`` registers.
"""
