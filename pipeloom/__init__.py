"""Pipe-network design analytics on Spark DataFrames."""
