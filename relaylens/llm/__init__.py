"""Operators for training-data pipelines over documents, pages and benchmark items.

Nothing else in the library imports this subpackage. ``queries.QUERIES`` and ``queries.ORACLES`` hold its named queries.
"""
