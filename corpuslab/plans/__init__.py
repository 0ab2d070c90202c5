"""Composed jobs, and the operators applied to the driver tables."""
