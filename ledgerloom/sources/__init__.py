"""Reading and writing the runtime's tables."""
