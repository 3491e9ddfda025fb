"""Pangenome graphs as Spark DataFrames."""
