"""Counts and summaries of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F



def counted(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of each value of the keys."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def in_target(chunks: DataFrame, artifacts: DataFrame, target_id: int | None) -> DataFrame:
    """Chunks of a target; of all targets without a join."""
    if target_id is None:
        return chunks
    return chunks.join(artifacts.filter(F.col("target_id") == target_id).select(F.col("id").alias("artifact_id")), "artifact_id", "left_semi")


def languages(df: DataFrame) -> DataFrame:
    """Languages by their count, the unknown left out."""
    return counted(df.filter("language is not null"), "language").orderBy(F.desc("n"), "language")


def pending(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: chunks that wait for a vector, and vectors of chunks that there are."""
    held = vectors.select("chunk_id").join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
    return chunks.agg(F.count_if(F.col("embed_model").isNull()).alias("pending_embed")).crossJoin(F.broadcast(held.agg(F.count("*").alias("vectors"))))


def top_groups(df: DataFrame, key: Column, name: str, n: int = 10, within: str | None = None) -> DataFrame:
    """The most frequent values, at most ``n`` (of each ``within``); ties by value."""
    keys = [within] if within else []
    rows = df.select(*keys, key.alias(name)).filter(F.col(name).isNotNull()).groupBy(*keys, name).agg(F.count("*").alias("n"))
    if not within:
        return rows.orderBy(F.desc("n"), name).limit(n)
    return rows.withColumn("_rank", F.row_number().over(W.partitionBy(within).orderBy(F.desc("n"), name))).filter(F.col("_rank") <= n).drop("_rank")


def repo_overview(repos: DataFrame, artifacts: DataFrame, chunks: DataFrame, n: int = 10) -> DataFrame:
    """A row for each repository of a target: its metadata, artifacts by kind, most frequent paths and
    authors, as arrays of structs. Repositories without artifacts have empty ones."""

    def listed(rows: DataFrame, name: str, out: str) -> DataFrame:
        return rows.groupBy("full_name").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("_o"), F.col(name).alias("_v")))), lambda s: F.struct(s["_v"].alias(name), (-s["_o"]).alias("n"))).alias(out))

    kinds = listed(artifacts.groupBy(F.col("repo").alias("full_name"), "kind").agg(F.count("*").alias("n")), "kind", "counts")
    paths = chunks.join(artifacts.select(F.col("id").alias("artifact_id"), F.col("repo").alias("full_name")), "artifact_id")
    paths = listed(top_groups(paths, F.get_json_object("context_json", "$.path"), "path", n, "full_name"), "path", "top_paths")
    authors = listed(top_groups(artifacts.withColumn("full_name", F.col("repo")), F.col("author_login"), "author_login", n, "full_name"), "author_login", "top_authors")
    facts = repos.select("target_id", "full_name", "default_branch", "head_sha", "pushed_at", "archived", "fork")
    for part in (kinds, paths, authors):
        facts = facts.join(part, "full_name", "left")
    return facts


def authors_of(artifacts: DataFrame, target_id: int | None, least: int = 1) -> DataFrame:
    """Authors of review comments with at least ``least`` of them, most first."""
    rows = artifacts.filter("kind = 'review_comment' and author_login is not null")
    rows = rows if target_id is None else rows.filter(F.col("target_id") == target_id)
    return counted(rows, "author_login").filter(F.col("n") >= least).orderBy(F.desc("n"), "author_login")


def summary_coverage(chunks: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Of each kind: chunks with a summary, all, and percent."""
    done = F.count_if(F.col("summary").isNotNull())
    return chunks.filter(F.col("kind").isin(*kinds)).groupBy("kind").agg(done.alias("done"), F.count("*").alias("total"), F.round(100.0 * done / F.count("*"), 4).alias("pct"))


def embed_coverage(chunks: DataFrame) -> DataFrame:
    """One row: chunks with a vector, all, and percent (0 of none)."""
    done = F.count_if(F.col("embed_model").isNotNull())
    return chunks.agg(done.alias("embedded"), F.count("*").alias("total"), F.when(F.count("*") > 0, F.round(100.0 * done / F.count("*"), 4)).otherwise(0.0).alias("pct"))


def cursor_progress(repos: DataFrame) -> DataFrame:
    """Of each target: repositories, active and archived, and active ones with each cursor."""
    live = ~F.coalesce(F.col("archived"), F.lit(False))
    return repos.groupBy("target_id").agg(
        F.count("*").alias("n_total"),
        F.count_if(live).alias("n_active"),
        F.count_if(~live).alias("n_archived"),
        *(F.count_if(live & F.col(c).isNotNull()).alias(n) for c, n in (("last_commits_at", "commits"), ("last_files_at", "files"), ("last_reviews_at", "reviews"))),
    )


def snapshot(targets: DataFrame, artifacts: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Of each target its artifacts by kind, a column for each kind, and in all."""
    counts = artifacts.groupBy("target_id").agg(F.count("*").alias("total"), *(F.count_if(F.col("kind") == k).alias(k) for k in kinds))
    joined = targets.select(F.col("id").alias("target_id"), "name", F.col("kind").alias("target_kind")).join(counts, "target_id", "left")
    return joined.fillna(0, ["total", *kinds])


def delta(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """What was added to the counts ``n`` of each key; keys of one side only count as 0 in the other."""
    both = before.select(key, F.col("n").alias("_a")).join(after.select(key, F.col("n").alias("_b")), key, "full_outer")
    return both.select(key, (F.coalesce("_b", F.lit(0)) - F.coalesce("_a", F.lit(0))).alias("added"))


def newest(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """The greatest text of a column."""
    return df.groupBy(*keys).agg(F.max(column).alias("newest"))


def eligibility(artifacts: DataFrame, since: str, decisions: tuple[str, ...]) -> DataFrame:
    """One row: review comments and decided pull requests of the held-out period."""
    late = F.col("created_at").isNotNull() & (F.col("created_at") >= F.lit(since))
    return artifacts.agg(F.count_if(late & (F.col("kind") == "review_comment")).alias("review_comments"), F.count_if(late & (F.col("kind") == "pr") & F.col("decision").isin(*decisions)).alias("decisioned_prs"))


def status(targets: DataFrame, repos: DataFrame, artifacts: DataFrame, chunks: DataFrame, vectors: DataFrame, current_repo: str | None = None) -> DataFrame:
    """One row on the state of the corpus and what to do next."""
    counts = targets.agg(F.count("*").alias("targets"))
    for df, name in ((artifacts, "artifacts"), (chunks, "chunks"), (vectors, "vectors")):
        counts = counts.crossJoin(F.broadcast(df.agg(F.count("*").alias(name))))
    counts = counts.crossJoin(F.broadcast(chunks.agg(F.count_if(F.col("embed_model").isNull()).alias("pending_embed"))))
    held = repos.agg(F.count_if(F.col("full_name") == F.lit(current_repo)).alias("_held"))
    advice = (
        F.when(F.col("targets") == 0, "add a scope")
        .when(F.col("artifacts") == 0, "ingest the scope")
        .when(F.col("vectors") == 0, "embed the chunks")
        .when(F.lit(current_repo is not None) & (F.col("_held") == 0), "ingest the current repository")
        .when(F.col("pending_embed") > 0, "embed the pending chunks")
        .otherwise("ready")
    )
    return counts.crossJoin(F.broadcast(held)).withColumn("recommendation", advice).withColumn("current_repo_indexed", F.col("_held") > 0).drop("_held")
