"""Code facts and training-data operators on Spark."""
