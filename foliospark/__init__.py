"""Document-change analytics and corpus preparation on PySpark DataFrames."""
