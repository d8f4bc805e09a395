"""Query performance prediction and term analytics on Spark DataFrames."""
