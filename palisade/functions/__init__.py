"""Column expressions: no DataFrame, no state."""
