"""Column helpers: text, numbers and time."""
