"""Alert-hygiene analytics on Spark."""
