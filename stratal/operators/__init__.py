"""Data-processing operators: DataFrames in, DataFrames out."""
