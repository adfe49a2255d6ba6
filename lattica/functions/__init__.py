"""Column functions and the reproducible random stream."""
