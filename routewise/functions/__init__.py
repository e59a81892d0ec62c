"""routewise.functions."""
