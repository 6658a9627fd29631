"""All registered queries."""

from __future__ import annotations

from . import queries_history, queries_scoring, queries_suites

ALL: dict = {**queries_scoring.QUERIES, **queries_suites.QUERIES, **queries_history.QUERIES}
