"""SQL for the core queries, for DuckDB over the same tables."""

from __future__ import annotations

from corvane.plans.queries import sql  # noqa: F401
