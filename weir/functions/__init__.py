"""Functions of weir."""
