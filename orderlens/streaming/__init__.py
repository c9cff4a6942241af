"""orderlens.streaming."""
