"""Listening-history and media-library analytics on PySpark."""
