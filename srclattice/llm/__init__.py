"""Operators of a training-data pipeline.

Nothing outside this folder imports it; the queries are in ``queries.py``.
"""
