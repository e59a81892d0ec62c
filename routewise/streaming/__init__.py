"""routewise.streaming."""
