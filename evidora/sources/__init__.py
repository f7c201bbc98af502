"""Readers and writers: search pages, documents, vectors, caches, fixtures and reports."""
