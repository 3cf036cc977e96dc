"""Column functions and the lexicons they take."""
