"""Forum and news-feed analytics as functions from DataFrames to DataFrames."""
