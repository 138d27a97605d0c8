"""A Spark-first engine for geocoded interferometry products and other gridded, time-paired observations."""
