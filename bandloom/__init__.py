"""Spark-native raster analytics: band maths, statistics, segmentation and rendering as DataFrame plans."""

__version__ = "0.1.0"
