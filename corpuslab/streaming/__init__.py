"""Logs, progress and unbounded sources, in batch and as streams."""
