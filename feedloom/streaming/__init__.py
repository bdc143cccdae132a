"""The same transformations under Structured Streaming."""
