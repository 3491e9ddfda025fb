"""Queries over the driver's tables, projected to a graph."""
