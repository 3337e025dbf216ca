"""Training-data operators: mixing, chat formatting, filtering, deduplication.

Nothing else in the library imports this subpackage. ``queries`` holds the
registered queries and ``sql`` their DuckDB oracles.
"""
