"""Composite runs: dictionaries of result DataFrames."""
