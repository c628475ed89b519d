"""Column functions: times and addresses."""
