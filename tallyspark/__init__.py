"""Count-outcome analytics on Spark."""
