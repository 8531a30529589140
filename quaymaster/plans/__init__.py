"""plans of the exposure engine."""
