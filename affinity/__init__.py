"""Affinity: related-document search and data preparation on Spark DataFrames."""
