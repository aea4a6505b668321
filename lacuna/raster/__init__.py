"""Raster kernels in numpy: one image (a two-dimensional uint8 array) at a time."""
