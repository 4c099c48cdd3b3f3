"""The engine applied to the city tables of the test data: their specifications, and all registered queries of the core."""
