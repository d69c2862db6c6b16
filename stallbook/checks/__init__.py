"""Catalogue of checked queries over the test tables, with their SQL."""
