"""Readers, collection tables and sinks."""
