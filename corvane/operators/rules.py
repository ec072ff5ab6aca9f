"""Rules and review comments: one of the copies under several targets, newest first, as Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.operators.filters import Filters

_META = "struct<cluster_size:int,member_repos:array<string>,member_urls:array<string>,author_login:string,repo_scope:string,rule_source:string,example_quotes:array<string>>"


def first_copies(artifacts: DataFrame, kind: str) -> DataFrame:
    """Of artifacts of a kind the first of each external_id, by target and id."""
    first = W.partitionBy("kind", "external_id").orderBy(F.col("target_id").asc_nulls_first(), "id")
    return artifacts.filter(F.col("kind") == kind).withColumn("_no", F.row_number().over(first)).filter("_no = 1").drop("_no")


def list_rules(chunks: DataFrame, artifacts: DataFrame, kind: str = "rule", language: str | None = None, repo: str | None = None, author: str | None = None, target_id: int | None = None, limit: int | None = 20) -> DataFrame:
    """rule, language, examples, cluster_size, repos and urls of rules, oldest first."""
    rules = artifacts.filter("kind = 'rule'")
    if target_id is None:
        rules = first_copies(rules, "rule")
    else:
        rules = rules.filter(F.col("target_id") == target_id)
    meta = F.from_json("meta_json", _META)
    rules = rules.select(F.col("id").alias("artifact_id"), meta.alias("m"))
    for value, field in ((author, "author_login"), (repo, "repo_scope")):
        if value is not None:
            rules = rules.filter(F.col(f"m.{field}") == F.lit(value))
    rows = chunks.filter(Filters(kind=kind, language=language).on_chunk()).select("id", "artifact_id", "text", "language", "context_json").join(rules, "artifact_id")
    rows = rows.select("id", F.col("text").alias("rule"), "language", F.get_json_object("context_json", "$.examples").alias("examples"), F.col("m.cluster_size").alias("cluster_size"), F.to_json("m.member_repos").alias("repos"), F.to_json("m.member_urls").alias("urls"))
    return rows.orderBy("id") if limit is None else rows.orderBy("id").limit(limit)


def recent_comments(chunks: DataFrame, artifacts: DataFrame, author: str | None = None, repo: str | None = None, language: str | None = None, target_id: int | None = None, limit: int | None = 50) -> DataFrame:
    """Review comments, newest first by the text of their date; those without date come last."""
    kept = first_copies(artifacts, "review_comment") if target_id is None else artifacts.filter((F.col("kind") == "review_comment") & (F.col("target_id") == target_id))
    for value, field in ((author, "author_login"), (repo, "repo"), (language, "language")):
        if value is not None:
            kept = kept.filter(F.col(field) == F.lit(value))
    rows = chunks.filter("kind = 'review_comment'").select("id", "artifact_id", "text").join(kept.select(F.col("id").alias("artifact_id"), "author_login", "repo", "source_url", F.coalesce("created_at", F.lit("")).alias("created_at")), "artifact_id")
    rows = rows.select("id", "artifact_id", "author_login", "repo", "source_url", "created_at", "text").orderBy(F.desc("created_at"), "id")
    return rows if limit is None else rows.limit(limit)


def latest_reviews(artifacts: DataFrame) -> DataFrame:
    """artifact_id, login and state of the last review of each reviewer of a pull request; of reviews
    of one time the first."""
    schema = "struct<reviewer_decisions:array<struct<login:string,state:string,submitted_at:string>>>"
    rows = artifacts.filter("kind = 'pr'").select(F.col("id").alias("artifact_id"), F.posexplode(F.from_json("meta_json", schema)["reviewer_decisions"]).alias("pos", "r"))
    rows = rows.select("artifact_id", "pos", F.col("r.login").alias("login"), F.col("r.state").alias("state"), F.coalesce("r.submitted_at", F.lit("")).alias("submitted_at")).filter("login is not null")
    last = W.partitionBy("artifact_id", "login").orderBy(F.desc("submitted_at"), "pos")
    return rows.withColumn("_no", F.row_number().over(last)).filter("_no = 1").select("artifact_id", "login", "state", "submitted_at")


def first_rows(df: DataFrame, limit: int, within: str, *order: Column) -> DataFrame:
    """The first ``limit`` rows of each group."""
    return df.withColumn("_no", F.row_number().over(W.partitionBy(within).orderBy(*order))).filter(F.col("_no") <= limit).drop("_no")


def markdown(rules: DataFrame, title: str) -> DataFrame:
    """One row: rules under a heading for each language, named ones in order of the alphabet, the rest
    last; each rule is a bullet with its quotes below. ``rules``: id, rule, language, examples."""
    quotes = F.from_json("examples", "array<string>")
    bullet = F.concat(F.lit("- "), F.col("rule"), F.coalesce(F.array_join(F.transform(quotes, lambda q: F.concat(F.lit("\n  > "), q)), ""), F.lit("")))
    parts = rules.groupBy("language").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", bullet.alias("b")))), lambda s: s["b"]).alias("_b"))
    section = F.concat(F.lit("## "), F.coalesce("language", F.lit("General")), F.lit("\n\n"), F.array_join("_b", "\n"))
    # One section a language; the languages of rules are few by nature.
    order = F.struct(F.col("language").isNull().alias("_null"), F.coalesce("language", F.lit("")).alias("_l"), section.alias("_s"))
    return parts.agg(F.concat(F.lit(f"# {title}\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda s: s["_s"]), "\n\n")).alias("markdown"))


def house_rules(chunks: DataFrame, artifacts: DataFrame, limit: int = 50, **scope) -> DataFrame:
    """One row: Markdown of the rules of reviews and of code, and how many of each."""
    review, code = list_rules(chunks, artifacts, "rule", limit=limit, **scope), list_rules(chunks, artifacts, "code_rule", limit=limit, **scope)
    both = markdown(review, "Review rules").select(F.col("markdown").alias("_r")).crossJoin(F.broadcast(markdown(code, "Code rules").select(F.col("markdown").alias("_c"))))
    counts = review.agg(F.count("*").alias("review_rules")).crossJoin(F.broadcast(code.agg(F.count("*").alias("code_rules"))))
    return both.crossJoin(F.broadcast(counts)).select(F.concat("_r", F.lit("\n\n"), "_c").alias("markdown"), "review_rules", "code_rules")


def sample_signature(ids: Column, prefix: str = "", digits: int = 40) -> Column:
    """sha1 of sorted ids, joined by commas, cut to some digits."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.array_join(F.transform(F.array_sort(ids), lambda i: i.cast("string")), ",")), 1, digits))


def developer_profile(chunks: DataFrame, artifacts: DataFrame, sample: int = 50, comment_chars: int = 600) -> DataFrame:
    """A profile for every author of review comments: login, Markdown of the newest ``sample``
    comments, their number, and a signature of the sample that tells whether a cached profile still
    holds. Authors without comments have none."""
    rows = chunks.filter("kind = 'review_comment'").select("id", "artifact_id", "text").join(first_copies(artifacts, "review_comment").select(F.col("id").alias("artifact_id"), "author_login", F.coalesce("created_at", F.lit("")).alias("created_at")), "artifact_id").filter("author_login is not null")
    rows = first_rows(rows, sample, "author_login", F.desc("created_at"), F.col("id"))
    said = F.transform(F.array_sort(F.collect_list(F.struct("id", F.substring("text", 1, comment_chars).alias("t")))), lambda s: F.concat(F.lit("> "), s["t"]))
    return rows.groupBy("author_login").agg(F.concat(F.lit("# "), F.first("author_login"), F.lit("\n\n"), F.array_join(said, "\n\n")).alias("profile_md"), F.count("*").alias("n_samples"), sample_signature(F.collect_list("id")).alias("sample_hash"))


def cached_profiles(fresh: DataFrame, cache: DataFrame) -> DataFrame:
    """Profiles, taken from the cache where its sample is the same: profile_md, from_cache."""
    old = cache.select("author_login", F.col("sample_hash").alias("_hash"), F.col("profile_md").alias("_md"))
    same = F.coalesce(F.col("_hash") == F.col("sample_hash"), F.lit(False))
    return fresh.join(old, "author_login", "left").select("author_login", F.when(same, F.col("_md")).otherwise(F.col("profile_md")).alias("profile_md"), "n_samples", "sample_hash", same.alias("from_cache"))


