"""All queries of this subpackage and their SQL. `__spark_entry__.py` adds them, and the pipeline at the repository's top, to the engine's own."""

from __future__ import annotations

from .queries import QUERIES
from .sql import SQL

__all__ = ["QUERIES", "SQL"]
