"""Column expressions: scaling, labels, daylight, projection, normal law."""
