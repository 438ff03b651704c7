"""Reading physical plans, to check that a query will hold up on large data."""
