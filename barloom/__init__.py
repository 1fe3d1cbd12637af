"""Time-series scoring, back-testing and market analytics as Spark DataFrame plans."""
