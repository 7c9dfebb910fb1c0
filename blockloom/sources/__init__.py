"""Scans and input batches."""
