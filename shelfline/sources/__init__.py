"""Feeds read into tables, and result sinks."""
