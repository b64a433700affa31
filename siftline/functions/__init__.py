"""Column functions: text, digests, paths and screening."""
