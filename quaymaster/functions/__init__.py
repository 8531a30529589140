"""functions of the exposure engine."""
