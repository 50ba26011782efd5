"""Operators of a training-data pipeline: text scoring, deduplication, search, packing.

Nothing else in the package imports this subpackage. Each module holds one operator with its own
general interface; ``queries`` holds the thin registered queries and their SQL.
"""
