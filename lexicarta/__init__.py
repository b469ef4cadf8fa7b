"""Lexicon, corpus-cleaning and recognition analytics on Spark DataFrames."""
