"""Predicates of retrieval and ingest as columns and joins; Catalyst pushes them into the scans."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.schema import EXCLUDED


@dataclass(frozen=True)
class Filters:
    """What hits must be: equal in each field that is given. ``author`` and ``repo`` are of the
    artifact, ``language``, ``node_kind`` and ``kind`` of the chunk."""

    kind: str | None = None
    language: str | None = None
    node_kind: str | None = None
    repo: str | None = None
    author: str | None = None
    target_id: int | None = None

    def on_chunk(self) -> Column:
        return _all(kind=self.kind, language=self.language, node_kind=self.node_kind)

    def on_artifact(self) -> Column | None:
        """The condition on artifacts; None if they needn't be joined."""
        fields = {"repo": self.repo, "author_login": self.author, "target_id": self.target_id}
        return _all(**fields) if any(v is not None for v in fields.values()) else None


def _all(**fields: object) -> Column:
    return reduce(lambda a, b: a & b, (F.col(k) == F.lit(v) for k, v in fields.items() if v is not None), F.lit(True))


def candidate_ids(chunks: DataFrame, artifacts: DataFrame, filters: Filters) -> DataFrame:
    """chunk_id of the chunks that pass; artifacts are joined only where a filter asks for them."""
    kept = chunks.filter(filters.on_chunk())
    if (condition := filters.on_artifact()) is not None:
        kept = kept.join(artifacts.filter(condition).select(F.col("id").alias("artifact_id")), "artifact_id", "left_semi")
    return kept.select(F.col("id").alias("chunk_id"))


def glob_regex(glob: str) -> str:
    """A regular expression for a shell glob in which ``*`` also crosses ``/``; an open bracket
    without end stands for itself."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c in "*?":
            out += ".*" if c == "*" else "."
        elif c == "[" and (end := glob.find("]", i + (2 if glob[i : i + 1] == "!" else 1))) > 0:
            inner = glob[i:end].replace("\\", "\\\\").replace("[", "\\[")
            out += "[" + ("^" + inner[1:] if inner[:1] == "!" else inner) + "]"
            i = end + 1
        else:
            out += re.escape(c) if not c.isalnum() and c not in "/_" else c
    return f"(?s)^{out}$"


def matches_glob(column: Column, *globs: str) -> Column:
    """Whether a text matches one of the globs as a whole, in its own case."""
    return column.rlike("|".join(f"(?:{glob_regex(g)})" for g in globs)) if globs else F.lit(False)


def excluded_path(path: Column) -> Column:
    """Lock files, packed and declared code, copies and builds."""
    return F.coalesce(matches_glob(path, *EXCLUDED), F.lit(False))


def keep_repos(full_name: Column, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    """Repositories that match an include glob (if there are any) and no exclude glob."""
    inside = matches_glob(full_name, *include) if include else F.lit(True)
    return inside & ~matches_glob(full_name, *exclude)


def needs_walk(pushed_at: Column, last_at: Column) -> Column:
    """Whether a repository changed since it was last walked; not known counts as changed. Times are
    compared as text."""
    return pushed_at.isNull() | last_at.isNull() | (pushed_at > last_at)


def needs_review(cursor: Column, updated_at: Column, state: Column, new_comments: Column) -> Column:
    """Whether a pull request is read again: never read, new comments, or closed and changed since."""
    return cursor.isNull() | F.coalesce(new_comments > 0, F.lit(False)) | F.coalesce((state != "open") & (updated_at > cursor), F.lit(False))


def held_out(created_at: Column, since: str) -> Column:
    """Records of the held-out period, compared as text."""
    return created_at.isNotNull() & (created_at >= F.lit(since))


def without_leaks(hits: DataFrame, artifacts: DataFrame, url: str, cutoff: str) -> DataFrame:
    """Hits whose artifact isn't from the cutoff on, by URL; hits without URL stay."""
    late = artifacts.filter(F.col("created_at") >= F.lit(cutoff)).select(F.col("source_url").alias(url)).filter(F.col(url).isNotNull()).distinct()
    return hits.join(late, url, "left_anti")


def prune_decision(held: DataFrame, kept: DataFrame, key: str, stale_before: str) -> DataFrame:
    """``held`` with ``reason``: not in ``kept``, else stale by its time, else null."""
    return held.join(kept.select(key, F.lit(True).alias("_kept")), key, "left").withColumn("reason", F.when(F.col("_kept").isNull(), "gone").when(F.col("used_at") < F.lit(stale_before), "stale")).drop("_kept")


def expectation(any_of: list[dict[str, object]]) -> Column:
    """Whether a hit fits one of the expectations, in one of its fields: ids, symbol and node kind
    are equal, parts of path and URL in their case, parts of the text in any case."""
    tests: list[Column] = []
    for wanted in any_of:
        for field, value in wanted.items():
            if field in ("chunk_id", "artifact_id", "symbol_name", "node_kind"):
                tests.append(F.col(field) == F.lit(value))
            elif field in ("path_substr", "url_substr"):
                tests.append(F.col(field.removesuffix("_substr")).contains(F.lit(value)))
            elif field == "text_substr":
                tests.append(F.lower("text").contains(F.lit(str(value).lower())))
            else:
                raise ValueError(f"unknown expectation: {field}")
    return F.coalesce(reduce(lambda a, b: a | b, (F.coalesce(t, F.lit(False)) for t in tests), F.lit(False)), F.lit(False))
