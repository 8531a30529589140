"""operators of the exposure engine."""
