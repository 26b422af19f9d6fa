"""Operators for training data made from code and documents; nothing else in the library imports this package."""
