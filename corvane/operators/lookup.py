"""Looking up one row, and columns promoted from JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


class Ambiguous(LookupError):
    """More than one row fits."""


def one_scope(targets: DataFrame, id: int | None = None, name: str | None = None, kind: str | None = None) -> Row | None:
    """The scope that fits all that is given; None if there is none, Ambiguous if there are more. At
    most two rows are fetched."""
    for field, value in (("id", id), ("name", name), ("kind", kind)):
        if value is not None:
            targets = targets.filter(F.col(field) == F.lit(value))
    found = targets.limit(2).collect()
    if len(found) > 1:
        raise Ambiguous("several scopes fit: give an id")
    return found[0] if found else None


def promoted(chunks: DataFrame) -> DataFrame:
    """Chunks with node_kind and symbol_name of their context where they have none."""
    get = lambda key: F.coalesce(F.col(key), F.get_json_object("context_json", f"$.{key}")).alias(key)
    return chunks.select(*[get(c) if c in ("node_kind", "symbol_name") else F.col(c) for c in chunks.columns])


def with_pushed(repos: DataFrame, pushed: DataFrame) -> DataFrame:
    """Repositories with the newest known push, from another listing where that has one."""
    new = pushed.groupBy("full_name").agg(F.max("pushed_at").alias("_new"))
    return repos.join(new, "full_name", "left").withColumn("pushed_at", F.coalesce("_new", "pushed_at")).select(*repos.columns)
