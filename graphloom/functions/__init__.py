"""Column functions on terms, names, units and registered functions."""
