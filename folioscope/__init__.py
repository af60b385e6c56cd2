"""Text and documentation analytics on Spark."""
