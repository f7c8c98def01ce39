"""Readers and writers: CSV trees, season tables, extracts, named sheets."""
