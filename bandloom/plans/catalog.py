"""All queries of the raster engine and the SQL that gives the same rows."""

from bandloom.plans import file_queries, picture_queries, place_queries, segment_queries, stats_queries, training_queries  # noqa: F401  (they register their queries)
from bandloom.plans.raster_queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
