"""Earth-observation dataset engine on Spark DataFrames."""
