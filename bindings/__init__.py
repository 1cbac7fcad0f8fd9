"""Every operator bound to the given tables, each with its SQL counterpart."""

from bindings import objects, questions, scoring, series, sources, statistics, validation  # noqa: F401
from bindings.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
