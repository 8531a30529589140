"""sources of the exposure engine."""
