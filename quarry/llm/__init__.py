"""Operators for preparing training data at scale; nothing else in the package imports this."""
