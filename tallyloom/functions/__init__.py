"""Column functions: payload parsing, statistics, grids."""
