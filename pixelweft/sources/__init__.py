"""Raster formats as Python data sources and writers."""
