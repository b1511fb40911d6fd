"""Causal time-series analytics as Spark plans."""
