"""Column functions: market calendar, numbers, text."""
