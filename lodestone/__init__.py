"""lodestone: session-memory analytics on Spark."""
