"""Step-by-step reasoning analytics on PySpark DataFrames."""
