"""Column functions: digests, normalisation, identifiers."""
