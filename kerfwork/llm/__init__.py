"""Operators for preparing text collections; nothing else in the package imports this."""
