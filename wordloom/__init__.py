"""Lexical and corpus analytics in Spark DataFrames."""
