"""Causal-graph analytics expressed as Spark DataFrames."""
