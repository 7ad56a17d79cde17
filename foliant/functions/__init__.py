"""functions of the foliant engine."""
