"""All registered queries and their SQL oracles."""

from scanlake.catalog import graphs, images, jobs, neighbours, places, poses, scans  # noqa: F401
from scanlake.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
