"""All registered queries of the engine's own operators and their SQL."""

from __future__ import annotations

from . import code, generated, graphs, monitoring, texts, vectors  # noqa: F401
from .base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
