"""Column expressions: rounding, text, geometry, signals, display."""
