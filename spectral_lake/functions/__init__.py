"""Column functions: coordinates, geometry, names."""
