"""Column functions: value text, analyzers and typed literals."""
