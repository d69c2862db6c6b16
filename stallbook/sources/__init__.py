"""Readers, writers, keyed stores and schema migrations."""
