"""Column -> Column functions; every one stays inside Spark's own expressions."""
