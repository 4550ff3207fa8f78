"""Column helpers and argument checks."""
