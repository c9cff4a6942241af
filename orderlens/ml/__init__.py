"""orderlens.ml."""
