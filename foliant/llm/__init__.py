"""Operators for preparing training data; nothing else in foliant imports this package."""
