"""Column expressions: parsing, cleaning, predicates and display labels."""
