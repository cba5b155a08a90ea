"""Training-data operators: filtering, deduplication, tokenisation and search over text tables.

Each module holds one operator with a general interface; ``registry`` holds the thin
queries and their SQL.  Nothing outside this package imports it.
"""
