"""Narrative-structure analytics on Spark: works in, graphs and pair scores out."""
