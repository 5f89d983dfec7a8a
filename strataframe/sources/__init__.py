"""Readers, writers and keyed maintenance of tables."""
