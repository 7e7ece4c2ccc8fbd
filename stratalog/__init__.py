"""Evidence search and analytics over conversation history, on Spark."""
