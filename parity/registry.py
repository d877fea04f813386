"""All queries and their SQL, collected."""

from parity import charts, correlation, ingest, profiling, semantic, whole  # noqa: F401
from parity.tools import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
