"""Retrieval analytics on Spark: tables of queries in, tables of ranked hits out."""
