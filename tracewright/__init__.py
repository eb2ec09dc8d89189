"""Token-trace analytics on Spark."""
