"""Incremental forms of aggregates whose state is a sum."""
