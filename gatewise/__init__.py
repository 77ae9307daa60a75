"""People-flow analytics and table processing on Spark DataFrames."""
