"""Column expressions: names, regions, dates, JSON, vectors."""
