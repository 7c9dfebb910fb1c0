"""Queries, rules and incremental runs."""
