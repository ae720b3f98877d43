"""Operators for building training text out of a library; nothing outside this package imports them."""
