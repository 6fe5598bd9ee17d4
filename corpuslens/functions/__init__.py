"""Column functions and pattern analysis."""
