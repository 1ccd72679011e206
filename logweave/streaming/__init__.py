"""Structured streaming jobs."""
