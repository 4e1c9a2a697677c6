"""The grid, the default configuration, and the queries."""
