"""routewise.plans."""
