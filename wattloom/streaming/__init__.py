"""Stream-shaped rules on Structured Streaming."""
