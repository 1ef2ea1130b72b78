"""Readers, caches and tables."""
