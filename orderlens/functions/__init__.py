"""orderlens.functions."""
