"""Flows of several operators."""
