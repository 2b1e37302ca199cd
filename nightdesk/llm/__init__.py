"""Operators for building training data: cleaning, filtering, deduplication, archives and packing.

Each module holds one operator with its own interface and the registered query that applies it
to a whole table.  Nothing outside this package imports it.
"""
