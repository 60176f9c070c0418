"""Named queries on the test tables, each with its SQL counterpart where SQL can say it."""

from __future__ import annotations

from . import blending, embedding, files, folds, graph, lexical, models, objectives, ranking, text  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
