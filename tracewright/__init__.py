"""Process analytics and training-data operators over Spark DataFrames."""
