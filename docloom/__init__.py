"""Document queries, updates and change streams on Spark DataFrames."""
