"""Queries of operators that the larger queries are made of, each with SQL of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import scalars
from corvane.operators import cluster, embed, evaluate, filters, fusion, rollups, rules, state, text_index, tools, vector
from corvane.plans.queries import _ASKED, _BM25, _KEYS, _TOK, SINCE, _asked, _corpus, _labelled, query, sql
from corvane.schema import DECISIONS
from corvane.sources.tables import table

# Filters and joins


@query("SELECT c.id % 10 AS query_id, c.id AS chunk_id, a.kind AS artifact_kind, a.language AS artifact_language, a.repo AS artifact_repo, a.source_url, a.decision, t.name AS target_name FROM chunk c JOIN artifact a ON a.id = c.artifact_id JOIN target_scope t ON t.id = a.target_id")
def pf1_hit_rows(spark: SparkSession, d: str) -> DataFrame:
    corpus = _corpus(spark, d)
    hits = corpus.chunks.select((F.col("id") % 10).alias("query_id"), F.col("id").alias("chunk_id"))
    rows = fusion.hit_rows(hits, corpus.chunks, corpus.artifacts, corpus.targets)
    return rows.select("query_id", "chunk_id", "artifact_kind", "artifact_language", "artifact_repo", "source_url", "decision", "target_name")


@query("SELECT count(*) FILTER (embed_model IS NULL) AS pending, count(*) FILTER (embed_model IS NOT NULL) AS done FROM chunk")
def pf4_queue_sizes(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunk")
    waiting = embed.pending(chunks).agg(F.count("*").alias("pending"))
    return waiting.crossJoin(F.broadcast(chunks.agg(F.count("embed_model").alias("done"))))


@query("SELECT id, decision FROM artifact WHERE decision IN ('approved', 'changes_requested', 'commented')")
def pf9_decided(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "artifact").filter(F.col("decision").isin(*DECISIONS)).select("id", "decision")


@query("SELECT c.id AS chunk_id FROM chunk c JOIN artifact a ON a.id = c.artifact_id WHERE c.kind = 'code' AND c.language = 'python' AND a.target_id = 2")
def jn3_candidates(spark: SparkSession, d: str) -> DataFrame:
    return filters.candidate_ids(table(spark, d, "chunk"), table(spark, d, "artifact"), filters.Filters(kind="code", language="python", target_id=2))


@query("SELECT id AS chunk_id FROM chunk WHERE kind = 'file' AND language = 'go'")
def jn4_no_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """No filter is on artifacts, so they aren't read."""
    return filters.candidate_ids(table(spark, d, "chunk"), table(spark, d, "artifact"), filters.Filters(kind="file", language="go"))


@query(sql()["ev1_held_out_comments"].replace(SINCE, "2025-06-01"))
def jn6_comments_and_chunks(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.held_out_comments(table(spark, d, "artifact"), table(spark, d, "chunk"), "2025-06-01").select("artifact_id", "chunk_id", "created_at")


def _lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two ranked lists of 50 for each of ten queries: the first and the last chunks."""
    rows = table(spark, d, "chunk").select((F.col("id") % 10).alias("query_id"), F.col("id").alias("chunk_id"))
    ranked = lambda *order: rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).filter("rank <= 50")
    return ranked("chunk_id"), ranked(F.col("chunk_id") % 97, F.desc("chunk_id"))


_TWO = "a AS (SELECT id % 10 AS query_id, id AS chunk_id, row_number() OVER (PARTITION BY id % 10 ORDER BY id) AS r FROM chunk QUALIFY r <= 50), b AS (SELECT id % 10 AS query_id, id AS chunk_id, row_number() OVER (PARTITION BY id % 10 ORDER BY id % 97, id DESC) AS r FROM chunk QUALIFY r <= 50)"


@query(f"WITH {_TWO}, f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, a.r AS vector_rank, b.r AS keyword_rank, coalesce(1.0::DOUBLE / (60 + a.r), 0) + coalesce(1.0::DOUBLE / (60 + b.r), 0) AS s FROM a FULL JOIN b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id) SELECT query_id, chunk_id, vector_rank, keyword_rank, round(s, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, vector_rank NULLS LAST, keyword_rank NULLS LAST, chunk_id) AS rank FROM f")
def jn7_fused_lists(spark: SparkSession, d: str) -> DataFrame:
    a, b = _lists(spark, d)
    rows = fusion.fuse(a, b, _corpus(spark, d).keys(), None)
    return rows.select("query_id", "chunk_id", F.col("vector_rank").cast("long").alias("vector_rank"), F.col("keyword_rank").cast("long").alias("keyword_rank"), F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_TWO} SELECT query_id, chunk_id FROM a UNION SELECT query_id, chunk_id FROM b")
def so2_union_of_lists(spark: SparkSession, d: str) -> DataFrame:
    a, b = _lists(spark, d)
    return fusion.fuse(a, b, _corpus(spark, d).keys(), None).select("query_id", "chunk_id")


@query(f"WITH {_TWO} SELECT a.query_id, a.r AS rank, md5(c.text) AS digest FROM a JOIN chunk c ON c.id = a.chunk_id JOIN artifact x ON x.id = c.artifact_id JOIN target_scope t ON t.id = x.target_id")
def jn8_rows_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Attributes are looked up and ranks stay."""
    corpus = _corpus(spark, d)
    rows = fusion.hit_rows(_lists(spark, d)[0], corpus.chunks, corpus.artifacts, corpus.targets)
    return rows.select("query_id", F.col("rank").cast("long").alias("rank"), F.md5("text").alias("digest"))


# Retrieval


@query("SELECT c.id AS chunk_id FROM chunk c JOIN artifact a ON a.id = c.artifact_id WHERE c.kind = 'review_comment' AND a.author_login = (SELECT author_login FROM artifact WHERE author_login IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)")
def rt3_candidates_of_author(spark: SparkSession, d: str) -> DataFrame:
    artifacts = table(spark, d, "artifact")
    login = rollups.top_groups(artifacts.filter("author_login is not null"), F.col("author_login"), "author_login", 1).first()
    return filters.candidate_ids(table(spark, d, "chunk"), artifacts, filters.Filters(kind="review_comment", author=login["author_login"] if login else ""))


@query("SELECT full_name, target_id, array_to_string(list_transform(string_split(full_name || ' ' || coalesce(default_branch, ''), ' '), lambda w: chr(34) || w || chr(34)), ' AND ') AS expression FROM repo WHERE full_name IS NOT NULL AND default_branch IS NOT NULL")
def rt5_expressions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "repo").filter("full_name is not null and default_branch is not null")
    rows = rows.select(F.struct("full_name", "target_id").alias("query_id"), F.concat_ws(" ", "full_name", "default_branch").alias("query"))
    return text_index.plain_queries(rows).select("query_id.full_name", "query_id.target_id", text_index.expression(F.col("groups")).alias("expression"))


@query("SELECT 'all' AS corpus, true AS ready UNION ALL SELECT 'without vectors', false UNION ALL SELECT 'without chunks', false")
def rt15_readiness(spark: SparkSession, d: str) -> DataFrame:
    from dataclasses import replace

    corpus = _corpus(spark, d)

    def ready(given: tools.Corpus) -> bool:
        try:
            tools.require_data(given)
        except tools.NotReady:
            return False
        return True

    cases = (("all", corpus), ("without vectors", replace(corpus, vectors=corpus.vectors.limit(0))), ("without chunks", replace(corpus, chunks=corpus.chunks.limit(0))))
    return spark.createDataFrame([(name, ready(given)) for name, given in cases], "corpus string, ready boolean")


@query(sql()["rt1_nearest"].replace("rank <= 10", "rank <= 3"))
def rk1_nearest_three(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    hits = vector.knn(vectors, vectors.filter("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id"), 3)
    return hits.select("query_id", "chunk_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_TOK}, {_ASKED}, {_BM25} SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 8), chunk_id) AS rank FROM bm QUALIFY rank <= 3")
def rk2_best_three(spark: SparkSession, d: str) -> DataFrame:
    hits = tools.keyword_search(_corpus(spark, d), _asked(spark, d), filters.Filters(), 3, coalesce=False)
    return hits.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_KEYS} SELECT chunk_id, akind AS artifact_kind, external_id, chunk_idx, created_at FROM keys")
def rk4_hit_keys(spark: SparkSession, d: str) -> DataFrame:
    return _corpus(spark, d).keys().select("chunk_id", "artifact_kind", "external_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), "created_at")


@query(sql()["rt2_filter_last"].replace("r <= 40", "r <= 15"))
def rk7_fetch_more(spark: SparkSession, d: str) -> DataFrame:
    """Three times as many are fetched as are wanted, since filters come after."""
    corpus = _corpus(spark, d)
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    wanted = filters.candidate_ids(corpus.chunks, corpus.artifacts, filters.Filters(kind="commit_message"))
    hits = vector.knn_then_filter(vectors, wanted, vectors.filter("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id"), 5, 3)
    return hits.select("query_id", "chunk_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query(sql()["ds2_list_rules"].replace("LIMIT 20", "LIMIT 7"))
def rk8_first_rules(spark: SparkSession, d: str) -> DataFrame:
    return rules.list_rules(table(spark, d, "chunk"), table(spark, d, "artifact"), limit=7).select("id", "rule", "language")


@query("SELECT id FROM artifact WHERE kind = 'review_comment' QUALIFY row_number() OVER (PARTITION BY kind, external_id ORDER BY target_id NULLS FIRST, id) = 1")
def wn2_first_comments(spark: SparkSession, d: str) -> DataFrame:
    return rules.first_copies(table(spark, d, "artifact"), "review_comment").select("id")


@query("SELECT count(*) AS n, round(avg(d), 6) AS mean, round(max(d), 6) AS most FROM (SELECT list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)")
def sf14_l2(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    pairs = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("v")).join(e.select((F.col("vec_id") - 1).alias("a"), F.col("embedding").alias("w")), "a")
    return pairs.select(vector.l2(F.col("v"), F.col("w")).alias("d")).agg(F.count("*").alias("n"), F.round(F.avg("d"), 6).alias("mean"), F.round(F.max("d"), 6).alias("most"))


@query("SELECT count(*) AS n, round(avg(d), 6) AS mean, round(min(d), 6) AS least FROM (SELECT list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)")
def jn14_products(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    pairs = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("v")).join(e.select((F.col("vec_id") - 1).alias("a"), F.col("embedding").alias("w")), "a")
    return pairs.select(vector.dot(F.col("v"), F.col("w")).alias("d")).agg(F.count("*").alias("n"), F.round(F.avg("d"), 6).alias("mean"), F.round(F.min("d"), 6).alias("least"))


# Rollups and clusters

_FACTS = sql()["ag11_cluster_facts"]


@query(f"SELECT cluster_id, external_id FROM ({_FACTS})")
def ag12_signatures(spark: SparkSession, d: str) -> DataFrame:
    return cluster.cluster_facts(_labelled(spark, d), table(spark, d, "chunk"), table(spark, d, "artifact")).select(F.col("cluster_id").cast("int").alias("cluster_id"), "external_id")


@query(f"SELECT cluster_id, unnest(string_split(repos, ',')) AS repo FROM ({_FACTS}) WHERE repos <> ''")
def ag27_cluster_repos(spark: SparkSession, d: str) -> DataFrame:
    facts = cluster.cluster_facts(_labelled(spark, d), table(spark, d, "chunk"), table(spark, d, "artifact"))
    return facts.select(F.col("cluster_id").cast("int").alias("cluster_id"), F.explode("member_repos").alias("repo"))


@query("SELECT id % 20 AS query_id, round(coalesce(sum(w) FILTER (decision = 'approved'), 0), 4) AS weight_approved, round(coalesce(sum(w) FILTER (decision = 'changes_requested'), 0), 4) AS weight_changes_requested, round(coalesce(sum(w) FILTER (decision = 'commented'), 0), 4) AS weight_commented, count(*) AS n_pulled FROM (SELECT id, decision, 1.0::DOUBLE / (1 + (id % 7) / 10.0::DOUBLE) AS w FROM artifact WHERE kind = 'pr') GROUP BY 1")
def ag25_vote_sums(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "artifact").filter("kind = 'pr'").select((F.col("id") % 20).alias("query_id"), ((F.col("id") % 7) / 10.0).alias("distance"), "decision")
    return tools.votes(hits).select("query_id", *(f"weight_{x}" for x in DECISIONS), "n_pulled")


@query("WITH b AS (SELECT repo, count(*) AS n FROM artifact WHERE id % 2 = 0 AND repo IS NOT NULL GROUP BY 1), a AS (SELECT repo, count(*) AS n FROM artifact WHERE id % 3 = 0 AND repo IS NOT NULL GROUP BY 1) SELECT repo, coalesce(a.n, 0) - coalesce(b.n, 0) AS added FROM b FULL JOIN a USING (repo)")
def so5_delta_of_repos(spark: SparkSession, d: str) -> DataFrame:
    artifacts = table(spark, d, "artifact").filter("repo is not null")
    return rollups.delta(rollups.counted(artifacts.filter("id % 2 = 0"), "repo"), rollups.counted(artifacts.filter("id % 3 = 0"), "repo"), "repo")


@query("WITH b AS (SELECT kind, count(*) AS n FROM chunk WHERE embed_model IS NOT NULL GROUP BY 1), a AS (SELECT kind, count(*) AS n FROM chunk GROUP BY 1) SELECT kind, coalesce(a.n, 0) - coalesce(b.n, 0) AS added FROM b FULL JOIN a USING (kind)")
def st11_sync_delta(spark: SparkSession, d: str) -> DataFrame:
    """What a run that embeds all pending chunks would add, by kind."""
    chunks = table(spark, d, "chunk")
    return rollups.delta(rollups.counted(chunks.filter("embed_model is not null"), "kind"), rollups.counted(chunks, "kind"), "kind")


# Scalars


@query("SELECT repo, 'sample-' || left(sha1(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id)), 12) AS signature FROM artifact WHERE repo IS NOT NULL GROUP BY repo")
def sf4_signatures(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "artifact").filter("repo is not null").groupBy("repo").agg(rules.sample_signature(F.collect_list("id"), "sample-", 12).alias("signature"))


@query("SELECT id, regexp_replace(regexp_replace(lower(left(text, 80)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM chunk WHERE text IS NOT NULL")
def sf5_slugs(spark: SparkSession, d: str) -> DataFrame:
    """The normal form of what chunks begin with."""
    return table(spark, d, "chunk").filter("text is not null").select("id", scalars.normalized(F.substring("text", 1, 80)).alias("slug"))


@query("SELECT target_id, full_name, CASE WHEN archived THEN coalesce(pushed_at, last_files_at) ELSE last_files_at END AS last_files_at, last_reviews_at FROM repo")
def st2_partial_cursors(spark: SparkSession, d: str) -> DataFrame:
    """Cursors of archived repositories move to their push; what isn't given stays."""
    repos = table(spark, d, "repo")
    moved = repos.filter("archived").select("target_id", "full_name", F.col("pushed_at").alias("last_files_at"), F.lit(None).cast("string").alias("last_reviews_at"))
    return state.set_repo_cursor(repos, moved).select("target_id", "full_name", "last_files_at", "last_reviews_at")


@query("SELECT id, length(text) AS n_chars FROM chunk WHERE embed_model IS NULL AND id > 100")
def st8_embedding_queue(spark: SparkSession, d: str) -> DataFrame:
    """The queue after the last id that a run has seen."""
    return embed.pending(table(spark, d, "chunk")).filter("id > 100").select("id", F.char_length("text").cast("long").alias("n_chars"))


@query("SELECT target_id, full_name FROM repo WHERE pushed_at <= last_files_at")
def st10_unchanged_repos(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "repo")
    return rows.filter(~filters.needs_walk(F.col("pushed_at"), F.col("last_files_at"))).select("target_id", "full_name")


@query("SELECT c.id FROM chunk c WHERE c.artifact_id NOT IN (SELECT id FROM artifact WHERE kind = 'commit')")
def up8_chunks_left(spark: SparkSession, d: str) -> DataFrame:
    artifacts, chunks = table(spark, d, "artifact"), table(spark, d, "chunk")
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return state.delete_artifacts(artifacts, chunks, vectors, artifacts.filter("kind = 'commit'").select("id"))[1].select("id")
