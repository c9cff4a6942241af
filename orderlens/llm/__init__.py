"""Training-data operators over a table of documents; nothing outside this package imports it."""
