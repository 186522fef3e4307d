"""Column builders: missing values, text parsing, exact statistics."""
