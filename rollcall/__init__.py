"""Entity resolution and semantic entity search on Spark DataFrames."""
