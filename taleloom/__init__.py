"""taleloom: spoken-archive analytics on Spark DataFrames."""
