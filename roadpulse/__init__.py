"""Connected-vehicle analytics as PySpark DataFrame operators and streaming jobs."""
