"""streaming of the foliant engine."""
