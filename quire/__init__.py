"""A document-layout analytics engine on Spark DataFrames."""
