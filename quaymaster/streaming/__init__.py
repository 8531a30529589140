"""streaming of the exposure engine."""
