"""Tiled raster analytics on Spark: containers, tile indexes, pixel operators."""

__version__ = "0.1.0"
