"""Operators for large-scale training-data work; nothing else in the package imports this subpackage."""
