"""Column functions: bit arithmetic of encodings, hashes, authenticated encryption."""
