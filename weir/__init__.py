"""weir: data workflows as graphs of Spark DataFrames."""
