"""Data operators: medallion steps, aggregates, lookups, changes, vectors, SQL guard."""
