"""Composite plans and the registry of queries."""
