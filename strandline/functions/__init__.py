"""Column functions: text normalisation and classification."""
