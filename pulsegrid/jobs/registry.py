"""All registered queries on the driver's tables, with their SQL."""

from __future__ import annotations

from . import edges, rhythm, scores, signals, texts

QUERIES: dict = rhythm.QUERIES | scores.QUERIES | signals.QUERIES | texts.QUERIES | edges.QUERIES
SQL: dict[str, str] = rhythm.SQL | scores.SQL | signals.SQL | texts.SQL | edges.SQL
