"""Column functions: exact arithmetic, bands, recommendation rules."""
