"""The reports: DataFrames in, one small or row-wise DataFrame out."""
