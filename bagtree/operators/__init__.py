"""Operators: DataFrames of many queries, documents or nodes in, DataFrames out."""
