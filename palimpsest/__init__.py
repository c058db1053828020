"""palimpsest: versioned-payload analytics on Spark DataFrames."""
