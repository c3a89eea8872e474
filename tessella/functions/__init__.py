"""Column functions: text, sets, statistics, vectors."""
