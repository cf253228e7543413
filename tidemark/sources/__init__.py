"""Readers: landed files to DataFrames with explicit schemas."""
