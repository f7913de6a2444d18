"""Column expressions: numbers, scores and texts."""
