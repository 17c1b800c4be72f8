"""Column expressions used inside table jobs."""
