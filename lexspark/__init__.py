"""lexspark: text analytics over Spark DataFrames."""
