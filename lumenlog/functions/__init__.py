"""Column functions over log text."""
