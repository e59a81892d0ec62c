"""routewise.sources."""
