"""Point-in-time market analytics on Spark."""
