"""Part of the raster engine; see README.md."""
