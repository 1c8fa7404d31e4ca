"""The registered queries over the given tables."""

from __future__ import annotations

from . import corpus, quality, questions, retrieval
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "corpus", "quality", "questions", "retrieval"]
