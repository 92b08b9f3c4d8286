"""Operators over the runtime's tables."""
