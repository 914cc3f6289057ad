"""Column functions: every function here takes columns and returns a column."""
