"""Column helpers and special functions."""
