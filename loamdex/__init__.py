"""Document search and corpus refinement on Spark DataFrames."""
