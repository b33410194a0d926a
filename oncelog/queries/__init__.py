"""The engine's queries over a folder of tables, with DuckDB SQL where SQL can express them."""

from . import audit, effects, gates, metrics, scalars, workloads  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
