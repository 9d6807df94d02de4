"""A columnar analytics engine on Spark DataFrames."""
