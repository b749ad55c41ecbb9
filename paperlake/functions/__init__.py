"""Column expressions: ids, text cleaning, token analysis, rank, vectors."""
