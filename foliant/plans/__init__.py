"""plans of the foliant engine."""
