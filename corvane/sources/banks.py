"""Banks of queries for evaluation, from YAML or JSON; unknown keys are errors."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from corvane.operators.filters import Filters
from corvane.schema import TIERS, TOOL_KINDS

_KEYS = {"query", "tool", "tier", "expect_any", "filters", "label"}
_EXPECT = {"path_substr", "text_substr", "url_substr", "symbol_name", "node_kind", "artifact_id", "chunk_id"}
_FILTERS = {"language", "repo", "author_login", "node_kind", "target_id", "path_glob"}


def parse_bank(text: str) -> list[dict[str, Any]]:
    """Entries of a bank: a list, or an object with ``queries``. Raises ValueError for what isn't one."""
    try:
        import yaml

        raw = yaml.safe_load(text)
    except ImportError:
        raw = json.loads(text)
    entries = raw.get("queries") if isinstance(raw, dict) else raw
    if not isinstance(entries, list):
        raise ValueError("a bank is a list of queries")
    out = []
    for k, entry in enumerate(entries):
        if not isinstance(entry, dict) or entry.keys() - _KEYS or not {"query", "tool", "tier", "expect_any"} <= entry.keys():
            raise ValueError(f"query {k}: keys must be among {sorted(_KEYS)}, all but filters and label are needed")
        if entry["tool"] not in TOOL_KINDS or entry["tier"] not in TIERS:
            raise ValueError(f"query {k}: unknown tool or tier")
        expected = entry["expect_any"]
        if not isinstance(expected, list) or not expected or any(not isinstance(e, dict) or not e or e.keys() - _EXPECT for e in expected):
            raise ValueError(f"query {k}: expect_any is a list of fields among {sorted(_EXPECT)}")
        given = entry.get("filters") or {}
        if not isinstance(given, dict) or given.keys() - _FILTERS:
            raise ValueError(f"query {k}: filters are among {sorted(_FILTERS)}")
        out.append({"query_id": k, "query": str(entry["query"]), "tool": entry["tool"], "tier": int(entry["tier"]), "label": entry.get("label") or str(entry["query"]), "expect_any": expected, "filters": given})
    return out


def filters_of(entry: dict[str, Any]) -> Filters:
    """The filters of an entry; its tool says the kind of chunk."""
    given = entry["filters"]
    return Filters(kind=TOOL_KINDS[entry["tool"]], language=given.get("language"), node_kind=given.get("node_kind"), repo=given.get("repo"), author=given.get("author_login"), target_id=given.get("target_id"))


def bank_table(spark: SparkSession, entries: list[dict[str, Any]]) -> DataFrame:
    """query_id, query, tool, tier and label of the entries."""
    return spark.createDataFrame([(e["query_id"], e["query"], e["tool"], e["tier"], e["label"]) for e in entries], "query_id long, query string, tool string, tier int, label string")
