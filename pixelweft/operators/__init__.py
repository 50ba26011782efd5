"""Raster operators: each takes rasters and returns a lazy raster."""
