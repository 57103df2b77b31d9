"""Entity resolution and quad analytics on Spark DataFrames."""
