"""Document and vector operators: DataFrames in, DataFrames out."""
