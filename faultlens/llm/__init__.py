"""Training-data operators, their queries and SQL. Nothing else in the library imports this package."""
