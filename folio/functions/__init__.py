"""Column functions over text, paths and vectors."""
