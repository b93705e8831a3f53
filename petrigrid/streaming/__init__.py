"""Edit streams on Structured Streaming."""
