"""Column functions and string helpers for RDF terms."""
