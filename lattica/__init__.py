"""Catalog-graph analytics on Spark DataFrames."""
