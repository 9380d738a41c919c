"""Column functions and rules."""
