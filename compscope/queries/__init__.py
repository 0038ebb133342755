"""Every operator as a query on the test tables, next to the SQL that checks it."""

from . import basics, graphs, learning, molecules, scores, similar  # noqa: F401  (they register)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
