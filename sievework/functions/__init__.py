"""Column expressions and rule tables."""
