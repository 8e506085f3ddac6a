"""Table operators: DataFrames in, DataFrames (or a few bounded numbers) out."""
