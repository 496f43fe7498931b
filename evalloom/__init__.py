"""Model-evaluation and training-data analytics on PySpark."""
