"""feedloom: syndication-feed processing on Spark DataFrames."""
