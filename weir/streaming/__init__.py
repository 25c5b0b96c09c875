"""Streaming of weir."""
