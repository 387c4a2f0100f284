"""Column functions: numbers, dates and text."""
