"""Log-incident analytics on Spark."""
