"""Column expressions: tokenisers and losses."""
