"""Event-driven refresh of the tables with Structured Streaming."""
