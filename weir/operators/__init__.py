"""Operators of weir."""
