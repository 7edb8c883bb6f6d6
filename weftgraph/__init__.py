"""Balanced graph partitioning and graph analytics on DataFrames."""
