"""Readers of landed files, parsers of their texts, and sinks."""
