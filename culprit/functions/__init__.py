"""Column expressions and frozen catalogs."""
