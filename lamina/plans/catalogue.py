"""All queries of the library but those of optional subpackages."""

from __future__ import annotations

from .files import files
from .layers import layers
from .settings import settings
from .tables import tables

PARTS = (layers, settings, tables, files)
QUERIES = {name: q for part in PARTS for name, q in part.queries.items()}
ORACLES = {name: sql for part in PARTS for name, sql in part.oracles.items()}
