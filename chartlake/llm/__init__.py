"""Operators of a training-data pipeline over documents, pages and embeddings.

Nothing else in the library imports this subpackage. Each operator has its own module with a
general interface; ``queries`` holds the thin registered queries.
"""
