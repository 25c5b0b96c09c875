"""Sources of weir."""
