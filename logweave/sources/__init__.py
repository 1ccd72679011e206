"""Readers, writers and one ingest job a transcript source."""
