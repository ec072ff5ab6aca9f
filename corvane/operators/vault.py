"""Pages of Markdown: rules, repositories and files; and writing them to a folder that may hold pages
edited by hand."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.scalars import file_page_path, repo_slug, rule_slug
from corvane.operators.state import page_actions
from corvane.runtime import durable

_FENCE = "---\ngenerated: true\n---\n\n"


def _page(*parts: Column) -> Column:
    return F.concat(F.lit(_FENCE), *parts)


def rule_pages(rules: DataFrame) -> DataFrame:
    """path and text of a page for each rule (rule, language, cluster_size)."""
    facts = F.concat(F.lit("\n\n- language: "), F.coalesce("language", F.lit("any")), F.lit("\n- members: "), F.coalesce(F.col("cluster_size").cast("string"), F.lit("?")), F.lit("\n"))
    return rules.select(F.concat(F.lit("rules/"), rule_slug(F.col("rule")), F.lit(".md")).alias("path"), _page(F.lit("# "), F.col("rule"), facts).alias("text")).dropDuplicates(["path"])


def repo_pages(overview: DataFrame) -> DataFrame:
    """path and text of a page for each repository, from repo_overview."""
    rows = lambda c, field: F.coalesce(F.array_join(F.transform(c, lambda s: F.concat(F.lit("\n- "), s[field], F.lit(": "), s["n"].cast("string"))), ""), F.lit(""))
    text = _page(F.lit("# "), F.col("full_name"), F.lit("\n\n## Counts\n"), rows(F.col("counts"), "kind"), F.lit("\n\n## Paths\n"), rows(F.col("top_paths"), "path"), F.lit("\n\n## Authors\n"), rows(F.col("top_authors"), "author_login"), F.lit("\n"))
    return overview.select(F.concat(F.lit("repos/"), repo_slug(F.col("full_name")), F.lit(".md")).alias("path"), text.alias("text")).dropDuplicates(["path"])


def file_pages(chunks: DataFrame, artifacts: DataFrame) -> DataFrame:
    """path and text of a page for each file, with its chunks in order."""
    files = chunks.filter("kind = 'file'").select("id", "artifact_id", "symbol_name", "summary", F.get_json_object("context_json", "$.path").alias("p")).filter("p is not null")
    files = files.join(artifacts.select(F.col("id").alias("artifact_id"), "repo").filter("repo is not null"), "artifact_id")
    line = F.concat(F.lit("\n- "), F.coalesce("symbol_name", F.lit("(lines)")), F.when(F.col("summary").isNotNull(), F.concat(F.lit(": "), F.col("summary"))).otherwise(""))
    grouped = files.groupBy("repo", "p").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("l")))), lambda s: s["l"]), "").alias("l"))
    return grouped.select(file_page_path(F.col("repo"), F.col("p")).alias("path"), _page(F.lit("# "), F.col("p"), F.lit("\n"), F.col("l"), F.lit("\n")).alias("text")).dropDuplicates(["path"])


def export(pages: DataFrame, existing: DataFrame, folder: str) -> DataFrame:
    """Bring the folder in line with ``pages`` and give the actions: pages are written by the workers,
    each beside its place and then renamed; pages edited by hand stay. The folder must be one that
    all workers share. ``existing``: path, text, generated."""
    # Actions are settled before anything is written.
    actions = durable(page_actions(pages, existing), "actions")
    todo = actions.filter(F.col("action").isin("written", "removed")).join(pages, "path", "left").select("path", "action", "text")

    def put(rows) -> None:
        for row in rows:
            place = os.path.realpath(os.path.join(folder, row["path"]))
            if not place.startswith(os.path.realpath(folder) + os.sep):
                raise ValueError(f"{row['path']} leads out of the folder")
            if row["action"] == "removed":
                if os.path.exists(place):
                    os.remove(place)
                continue
            os.makedirs(os.path.dirname(place), exist_ok=True)
            with open(f"{place}.new", "w", encoding="utf-8") as f:
                f.write(row["text"])
            os.replace(f"{place}.new", place)

    todo.foreachPartition(put)
    return actions
