"""Event-log jobs as Structured Streaming queries."""
