"""Evidence and rules analytics on Spark."""
