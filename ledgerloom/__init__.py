"""Spark operators over the tables of a sharded message-and-workflow runtime."""
