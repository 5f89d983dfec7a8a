"""Lexical and sparse-vector retrieval as joins and aggregates."""
