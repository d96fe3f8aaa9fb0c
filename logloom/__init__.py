"""Session-log analytics on Spark."""
