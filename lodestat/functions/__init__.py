"""Column functions, the expression language and distributions."""
