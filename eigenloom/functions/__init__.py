"""Column expressions on pixel arrays, and the numpy helpers used inside tasks."""
