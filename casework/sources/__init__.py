"""Readers that turn evidence packages and result folders into DataFrames."""
