"""Column functions and their plain Python twins."""
