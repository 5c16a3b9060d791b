"""lodestream: a PySpark-native engine for evidence analytics over trial, drug and text data.

Every public operator takes DataFrames and returns DataFrames; plans stay lazy unless a
docstring says that a small, bounded result is fetched at plan time.
"""
