"""operators of the foliant engine."""
