"""sources of the foliant engine."""
