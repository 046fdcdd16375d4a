"""Routes as Structured Streaming queries."""
