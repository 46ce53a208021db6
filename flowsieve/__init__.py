"""Network-flow anomaly analytics as plain Spark DataFrame operators."""
