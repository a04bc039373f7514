"""Training-data operators: deduplication, scoring, tokenising, search and mixing.

Nothing outside this subpackage imports it.  Each operator is a function on
DataFrames with its own general interface; ``queries`` binds them to the tables.
"""
