"""Structured Streaming forms of the operators whose result depends on arrival order or time."""
