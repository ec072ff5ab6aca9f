"""Held-out examples and measures of retrieval and prediction."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions.scalars import is_blank
from corvane.operators.filters import held_out, matches_glob
from corvane.operators.fusion import hit_rows
from corvane.operators.tools import Corpus, all_modes
from corvane.schema import DECISIONS, OVER_GLOB, TIERS, TOP


def held_out_comments(artifacts: DataFrame, chunks: DataFrame, since: str, limit: int | None = None) -> DataFrame:
    """Review comments of the held-out period with hunk and comment, oldest first. The limit comes
    before blank ones are left out."""
    rows = artifacts.filter((F.col("kind") == "review_comment") & held_out(F.col("created_at"), since)).select(F.col("id").alias("artifact_id"), "repo", "source_url", "language", "created_at")
    rows = rows.join(chunks.filter("kind = 'review_comment'").select(F.col("id").alias("chunk_id"), "artifact_id", "text", "context_json"), "artifact_id")
    rows = rows.select("artifact_id", "chunk_id", "repo", F.col("source_url").alias("url"), "language", "created_at", F.col("text").alias("truth_comment"), F.get_json_object("context_json", "$.diff_hunk").alias("diff_hunk"), F.get_json_object("context_json", "$.pr_title").alias("pr_title")).orderBy("created_at", "chunk_id")
    rows = rows if limit is None else rows.limit(limit)
    return rows.filter(~is_blank(F.col("diff_hunk")) & ~is_blank(F.col("truth_comment")))


def held_out_pulls(artifacts: DataFrame, chunks: DataFrame, since: str, reviewer: str | None = None) -> DataFrame:
    """Pull requests of the held-out period with a decision: the artifact's own, or that of a
    reviewer. Title is of the metadata, body what follows the first blank line of the summary."""
    from corvane.operators.tools import reviewer_decision

    rows = artifacts.filter((F.col("kind") == "pr") & held_out(F.col("created_at"), since))
    truth = F.col("decision") if reviewer is None else reviewer_decision(F.col("meta_json"), reviewer)
    rows = rows.select(F.col("id").alias("artifact_id"), "repo", F.col("source_url").alias("url"), "created_at", F.get_json_object("meta_json", "$.title").alias("title"), truth.alias("truth"))
    summaries = chunks.filter("kind = 'pr_summary'").select("artifact_id", F.col("id").alias("chunk_id"), "text")
    rows = rows.join(summaries, "artifact_id", "left").filter(F.col("truth").isin(*DECISIONS))
    body = F.when(F.col("text").contains("\n\n"), F.expr("substring(text, locate('\n\n', text) + 2)")).otherwise("")
    return rows.select("artifact_id", "chunk_id", "repo", "url", "created_at", "title", body.alias("body"), "truth")


def pass_rates(outcomes: DataFrame, *keys: str) -> DataFrame:
    """passed and total of each value of the keys, and of all values of each (null), by rollup."""
    return outcomes.rollup(*keys).agg(F.count_if("passed").alias("passed"), F.count("*").alias("total"))


def gate(outcomes: DataFrame) -> DataFrame:
    """Of each tier of the fused mode: rate, goal, whether it is met; only the first tier ``fails``."""
    goal = F.element_at(F.create_map(*[F.lit(x) for pair in TIERS.items() for x in pair]), F.col("tier"))
    rows = outcomes.filter("mode = 'hybrid'").groupBy("tier").agg((F.count_if("passed") / F.count("*")).alias("rate"))
    return rows.select("tier", F.round("rate", 6).alias("rate"), goal.alias("goal"), (F.col("rate") >= goal).alias("met"), ((F.col("tier") == 1) & (F.col("rate") < goal)).alias("fails"))


def accuracy(df: DataFrame, truth: str = "truth", predicted: str = "prediction") -> DataFrame:
    """One row: the share of right predictions; a null one is wrong; null of no rows."""
    return df.agg(F.avg(F.when(F.col(truth) == F.col(predicted), 1.0).otherwise(0.0)).alias("accuracy"), F.count("*").alias("n"))


def class_f1(df: DataFrame, truth: str = "truth", predicted: str = "prediction", classes: tuple[str, ...] = DECISIONS) -> DataFrame:
    """F1 of each class, 0 where it isn't defined."""
    hits = df.agg(*(F.count_if((F.col(truth) == c) & (F.col(predicted) == c)).alias(f"{c}_tp") for c in classes), *(F.count_if(F.col(truth) == c).alias(f"{c}_t") for c in classes), *(F.count_if(F.col(predicted) == c).alias(f"{c}_p") for c in classes))
    rows = hits.select(F.explode(F.array(*(F.struct(F.lit(c).alias("class"), F.col(f"{c}_tp").alias("tp"), (F.col(f"{c}_t") + F.col(f"{c}_p")).alias("both")) for c in classes))).alias("r"))
    return rows.select("r.class", F.when(F.col("r.tp") > 0, F.round(2.0 * F.col("r.tp") / F.col("r.both"), 6)).otherwise(0.0).alias("f1"))


def majority(df: DataFrame, truth: str = "truth") -> DataFrame:
    """One row: the most frequent class, by its order on ties, and its share."""
    counts = df.groupBy(F.col(truth).alias("class")).agg(F.count("*").alias("n"))
    return counts.agg(F.max(F.struct("n", (-_place(F.col("class"))).alias("o"), "class")).alias("m"), F.sum("n").alias("all")).select(F.col("m.class").alias("class"), F.round(F.col("m.n") / F.col("all"), 6).alias("share"))


def _place(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, DECISIONS)), c)


def paired_t(pairs: DataFrame, before: str, after: str) -> tuple[float | None, float | None]:
    """(t, p) that ``before`` exceeds ``after``, one-sided with the normal distribution; (None, None)
    for fewer than two pairs. All rows become three numbers before the driver sees them."""
    gap = F.col(before) - F.col(after)
    n, mean, sd = pairs.filter(gap.isNotNull()).agg(F.count("*"), F.avg(gap), F.stddev_samp(gap)).first()
    if n < 2:
        return None, None
    if sd == 0:
        return (math.inf, 0.0) if mean > 0 else (0.0, 1.0)
    t = mean / (sd / math.sqrt(n))
    return t, 0.5 * math.erfc(t / math.sqrt(2))


def expectations(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """query_id, field and value of all that hits of the entries of a bank may fit."""
    rows = [(e["query_id"], field, str(value)) for e in entries for wanted in e["expect_any"] for field, value in wanted.items()]
    return spark.createDataFrame(rows, "query_id long, field string, value string")


def fits(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """query_id of hits (query_id, chunk_id, artifact_id, path, url, text, symbol_name, node_kind) that
    fit one of the expectations of their query (see filters.expectation for what fitting is)."""
    value, field = F.col("value"), F.col("field")
    test = F.lit(False)
    for name in ("chunk_id", "artifact_id", "symbol_name", "node_kind"):
        test = F.when(field == name, F.col(name).cast("string") == value).otherwise(test)
    test = F.when(field == "path_substr", F.col("path").contains(value)).when(field == "url_substr", F.col("url").contains(value)).when(field == "text_substr", F.lower("text").contains(F.lower(value))).otherwise(test)
    return rows.join(expected, "query_id").filter(F.coalesce(test, F.lit(False))).select("query_id").distinct()


def run_bank(corpus: Corpus, entries: list[dict], queries: DataFrame, modes: tuple[str, ...] = ("vector", "bm25", "hybrid"), k: int = TOP, half_life_days: float | None = None, now: str | None = None) -> DataFrame:
    """query_id, tool, tier, label, mode and passed of every entry of a bank in every mode. ``queries``:
    query_id, query and embedding of the entries. Entries with one tool and the same filters are one
    search; the half-life counts in the fused mode only. A bank is a list of few entries."""
    from corvane.sources.banks import bank_table, filters_of

    spark = queries.sparkSession
    bank, expected = bank_table(spark, entries), expectations(spark, entries)
    groups: dict[tuple, list[dict]] = {}
    for e in entries:
        groups.setdefault((filters_of(e), e["filters"].get("path_glob")), []).append(e)
    passed = None
    for (wanted, glob), members in groups.items():
        asked = queries.filter(F.col("query_id").isin(*(e["query_id"] for e in members)))
        fetch = k * OVER_GLOB if glob else k
        found_by = all_modes(corpus, asked, wanted, fetch, half_life_days=half_life_days, now=now)
        for mode in modes:
            hits = found_by[mode]
            rows = hit_rows(hits.select("query_id", "chunk_id", "rank"), corpus.chunks, corpus.artifacts, corpus.targets).withColumns({"path": F.get_json_object("context_json", "$.path"), "url": F.col("source_url")})
            if glob:
                rows = rows.filter(F.coalesce(matches_glob(F.col("path"), glob), F.lit(False)))
                rows = rows.withColumn("_no", F.row_number().over(W.partitionBy("query_id").orderBy("rank"))).filter(F.col("_no") <= k)
            found = fits(rows, expected).withColumn("mode", F.lit(mode))
            passed = found if passed is None else passed.unionByName(found)
    every = bank.select("query_id", "tool", "tier", "label", F.explode(F.array(*map(F.lit, modes))).alias("mode"))
    if passed is None:
        return every.withColumn("passed", F.lit(False))
    return every.join(passed.withColumn("passed", F.lit(True)), ["query_id", "mode"], "left").fillna(False, ["passed"])


def review_report(distances: DataFrame, before: str = "baseline", after: str = "informed") -> DataFrame:
    """One row: n, the mean of both distances, delta (how much nearer ``after`` is), t and p of
    paired_t; means of no rows, and t and p of fewer than two, are null."""
    spark = distances.sparkSession
    pairs = distances.filter(F.col(before).isNotNull() & F.col(after).isNotNull())
    t, p = paired_t(pairs, before, after)
    facts = pairs.agg(F.count("*").alias("n"), F.round(F.avg(before), 6).alias(f"mean_{before}"), F.round(F.avg(after), 6).alias(f"mean_{after}"), F.round(F.avg(F.col(before) - F.col(after)), 6).alias("delta"))
    tested = spark.createDataFrame([(None if t is None else round(t, 6), None if p is None else round(p, 6))], "t double, p double")
    return facts.crossJoin(F.broadcast(tested))
