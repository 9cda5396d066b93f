"""Compositional count data and messy metadata on Spark: lazy DataFrame operators."""
