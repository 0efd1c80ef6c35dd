"""Vector-space audit engine on Spark DataFrames."""
