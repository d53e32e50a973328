"""Column functions and small values."""
