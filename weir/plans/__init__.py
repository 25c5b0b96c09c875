"""Plans of weir."""
