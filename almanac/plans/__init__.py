"""The query catalog: every module adds its queries and their SQL."""

from . import geocoding, linking, registers  # noqa: F401
from .catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
