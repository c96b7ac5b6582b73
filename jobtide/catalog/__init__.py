"""The registered queries and their SQL counterparts."""

from . import functions, ingest, operators, plans, storage  # noqa: F401
from .base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
