"""Column functions: partition transforms and geometry statistics."""
