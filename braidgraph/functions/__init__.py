"""Column functions: names, packing, text forms."""
