"""Market time-series analytics and training-data preparation on PySpark."""
