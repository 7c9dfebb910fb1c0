"""Replay-safe writes and table maintenance."""
