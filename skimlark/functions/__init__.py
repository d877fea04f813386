"""Column expressions and the shared aggregation building blocks."""
