"""Jobs and the queries that exercise them."""
