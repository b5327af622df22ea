"""Operators for training text and record fusion. Nothing else in the package imports this subpackage."""
