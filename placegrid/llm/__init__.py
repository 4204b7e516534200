"""Operators of a training-data pipeline: cleaning, near copies, tokens, packing, search and scoring of documents.

Nothing else in the library imports this subpackage.
"""
