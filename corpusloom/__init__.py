"""Spark jobs that turn large mixed collections of text, pages and tables into searchable evidence."""
