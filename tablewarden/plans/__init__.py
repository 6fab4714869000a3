"""End-to-end plans: audit a table, repair a table."""
