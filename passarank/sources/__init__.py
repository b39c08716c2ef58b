"""Readers and writers of pages, tables, nested exports and vector collections."""
