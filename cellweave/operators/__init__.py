"""Raster operators, by family."""
