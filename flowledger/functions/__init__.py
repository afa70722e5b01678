"""Column functions: numbers, units, names, physics and curves, all as native expressions."""
