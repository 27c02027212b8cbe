"""Operators for training-data preparation. Nothing else in quire imports this subpackage."""
