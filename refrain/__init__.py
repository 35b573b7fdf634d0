"""Content identification over timestamped feature vectors, on Spark DataFrames."""
