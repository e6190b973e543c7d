"""Derived input tables, the per-session workspace and the query registry."""
