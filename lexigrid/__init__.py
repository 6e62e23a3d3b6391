"""Corpus and translation-model analytics on PySpark DataFrames."""
