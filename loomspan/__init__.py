"""Text-corpus retrieval and digest analytics on Spark."""
