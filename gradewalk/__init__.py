"""Grade-aware walking-network analytics on Spark."""
