"""Column functions and Arrow functions."""
