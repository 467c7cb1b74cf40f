"""Table and stream operators for industrial asset data on Spark DataFrames."""
