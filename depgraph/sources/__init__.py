"""Readers and writers for the feeds and for the stored graph."""
