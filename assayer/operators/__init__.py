"""Jobs and job stages: DataFrames in, DataFrames out."""
