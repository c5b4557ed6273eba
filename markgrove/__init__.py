"""Markup analytics on Spark: documents, tokens and element trees as DataFrames."""
