"""Analytics over weighted, annotated directed graphs and the tables around them, on Spark DataFrames."""
