"""Column functions: text, predicates, geometry, inline tokens."""
