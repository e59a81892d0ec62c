"""routewise.operators."""
