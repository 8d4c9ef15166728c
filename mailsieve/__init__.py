"""Mail analytics and search as lazy Spark DataFrames."""
