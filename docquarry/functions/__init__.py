"""Column functions: text, values, arrays."""
