"""Incremental campaigns."""
