"""Evidence-backed code graphs on Spark DataFrames."""
