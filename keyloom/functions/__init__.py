"""Column functions on text and on sequence and mutation notation."""
