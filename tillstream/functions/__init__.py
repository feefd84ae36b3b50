"""Column functions for receipt text."""
