"""Column functions: dates, numbers, text and name patterns."""
