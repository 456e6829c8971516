"""Column functions and image functions."""
