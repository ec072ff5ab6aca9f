"""Queries of the core operators over the tables of a data folder, with SQL that gives the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import expand, languages, scalars
from corvane.operators import chunkers, cluster, embed, evaluate, filters, fusion, lookup, models, rollups, rules, state, text_index, tools, vault, vector
from corvane.schema import ARTIFACT_KINDS, DECISIONS, SUMMARIZABLE
from corvane.sources.tables import table
from corvane.streaming import sync

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: Begin of the held-out period, and the clock of ages.
SINCE, NOW = "2026-01-01", "2026-06-01T00:00:00Z"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with SQL that gives the same where there is one."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    """Queries by name."""
    return dict(_QUERIES)


def sql() -> dict[str, str]:
    """SQL by query name."""
    return dict(_SQL)


_STORED: dict[tuple, tools.Corpus] = {}


def _stamp(spark: SparkSession, path: str) -> int:
    """When a table was last written."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target).getModificationTime()


def _plain_corpus(spark: SparkSession, d: str) -> tools.Corpus:
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return tools.Corpus(table(spark, d, "target_scope"), table(spark, d, "artifact"), table(spark, d, "chunk"), vectors, ascii_only=True)


def _corpus(spark: SparkSession, d: str) -> tools.Corpus:
    """The corpus with its index, which is written by the first search of a session and again when a
    table was written since."""
    names = ("chunk", "artifact", "embeddings")
    key = (spark.sparkContext.applicationId, d, *(_stamp(spark, f"{d.rstrip('/')}/{n}.parquet") for n in names))
    if key not in _STORED:
        _STORED[key] = _plain_corpus(spark, d).stored()
    return _STORED[key]


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: chunks whose id is divisible by 100, with their vector and first words."""
    words = F.array_join(F.slice(text_index.raw_terms(F.col("text"), True), 1, 3), " ")
    chunks = table(spark, d, "chunk").filter("id % 100 = 0").select(F.col("id").alias("query_id"), words.alias("query"))
    return chunks.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding"), "query_id")


# Parts of the SQL.
_KEYS = "keys AS (SELECT n.chunk_id, n.chunk_idx, a.kind AS akind, a.external_id, a.created_at FROM (SELECT id AS chunk_id, artifact_id, row_number() OVER (PARTITION BY artifact_id ORDER BY id) AS chunk_idx FROM chunk) n JOIN artifact a ON a.id = n.artifact_id)"
_TOK = "tok AS (SELECT id AS chunk_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM chunk WHERE text IS NOT NULL), tf AS (SELECT chunk_id, term, count(*) AS f FROM tok GROUP BY ALL), dl AS (SELECT chunk_id, count(*) AS len FROM tok GROUP BY ALL), st AS (SELECT (SELECT count(*) FROM chunk WHERE text IS NOT NULL) AS docs, sum(len)::DOUBLE / (SELECT count(*) FROM chunk WHERE text IS NOT NULL) AS avgdl FROM dl), dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL)"
_ASKED = "asked AS (SELECT c.id AS query_id, list_slice(regexp_extract_all(lower(c.text), '[a-z0-9_]+'), 1, 3) AS terms, CAST(e.embedding AS DOUBLE[]) AS qv FROM chunk c JOIN embeddings e ON e.vec_id = c.id WHERE c.id % 100 = 0)"
#: Words count once for each place in a query; a word that stands twice is a group twice.
_BM25 = "qt AS (SELECT query_id, unnest(terms) AS term, generate_subscripts(terms, 1) AS grp FROM asked), need AS (SELECT query_id, count(*) AS n FROM qt GROUP BY ALL), sc AS (SELECT qt.query_id, tf.chunk_id, -sum((CASE WHEN ln((st.docs - d.df + 0.5::DOUBLE) / (d.df + 0.5::DOUBLE)) <= 0 THEN 1e-6::DOUBLE ELSE ln((st.docs - d.df + 0.5::DOUBLE) / (d.df + 0.5::DOUBLE)) END) * tf.f * 2.2::DOUBLE / (tf.f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl.len / st.avgdl))) AS score, count(*) AS met FROM qt JOIN tf ON tf.term = qt.term JOIN dl ON dl.chunk_id = tf.chunk_id JOIN dfs d ON d.term = qt.term CROSS JOIN st GROUP BY qt.query_id, tf.chunk_id), bm AS (SELECT sc.* FROM sc JOIN need USING (query_id) WHERE met = n)"


def _dedup(hits: str, order: str, k: int | str) -> str:
    return f"(SELECT query_id, chunk_id, v, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS rank FROM (SELECT h.*, row_number() OVER (PARTITION BY query_id, akind, external_id, chunk_idx ORDER BY {order}) AS cp FROM {hits} h JOIN keys USING (chunk_id)) WHERE cp = 1 QUALIFY rank <= {k})"


def _legs(kind: str, k: int) -> str:
    near = f"nearall AS (SELECT a.query_id, c.id AS chunk_id, list_distance(CAST(e.embedding AS DOUBLE[]), a.qv) AS v FROM asked a, embeddings e JOIN chunk c ON c.id = e.vec_id WHERE c.kind = '{kind}' AND len(a.terms) > 0)"
    words = f"bmall AS (SELECT bm.query_id, bm.chunk_id, bm.score AS v FROM bm JOIN chunk c ON c.id = bm.chunk_id WHERE c.kind = '{kind}')"
    return f"WITH {_KEYS}, {_TOK}, {_ASKED}, {_BM25}, {near}, {words}, vl AS {_dedup('nearall', 'round(v, 9), chunk_id', k)}, bl AS {_dedup('bmall', 'round(v, 8), chunk_id', k)}"


def _fused(kind: str, decay: bool = False) -> str:
    base = "coalesce(1.0::DOUBLE / (60 + vl.rank), 0) + coalesce(1.0::DOUBLE / (60 + bl.rank), 0)"
    shaped = r"regexp_matches(k.created_at, '^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$')"
    age = f"greatest(0, (epoch_us(TIMESTAMPTZ '{NOW}') - epoch_us(TRY_CAST(CASE WHEN regexp_matches(k.created_at, '(Z|[+-][0-9][0-9]:?[0-9][0-9])$') THEN k.created_at ELSE k.created_at || '+00:00' END AS TIMESTAMPTZ))) / 8.64e10)"
    score = f"CASE WHEN k.akind IN ('commit','pr','review_comment','issue_comment') AND {shaped} AND {age} IS NOT NULL THEN ({base}) * pow(0.5, {age} / 365) ELSE {base} END" if decay else base
    return f"{_legs(kind, 50)}, fu AS (SELECT coalesce(vl.query_id, bl.query_id) AS query_id, coalesce(vl.chunk_id, bl.chunk_id) AS chunk_id, vl.rank AS vr, bl.rank AS br, {score} AS score FROM vl FULL JOIN bl ON bl.query_id = vl.query_id AND bl.chunk_id = vl.chunk_id LEFT JOIN keys k ON k.chunk_id = coalesce(vl.chunk_id, bl.chunk_id)), rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vr NULLS LAST, br NULLS LAST, chunk_id) AS rank FROM fu)"


_HITS = "JOIN chunk c ON c.id = rk.chunk_id JOIN artifact a ON a.id = c.artifact_id JOIN target_scope t ON t.id = a.target_id"
_CUT = "CASE WHEN len(string_split({0}, chr(10))) > 40 THEN array_to_string(list_slice(string_split({0}, chr(10)), 1, 40), chr(10)) || chr(10) || '... [+' || CAST(len(string_split({0}, chr(10))) - 40 AS VARCHAR) || ' more lines]' ELSE {0} END"
_VALID = "json_valid(c.context_json)"


def _ctx(key: str) -> str:
    return f"CASE WHEN {_VALID} THEN json_extract_string(c.context_json, '$.{key}') END"


# Scans


@query("SELECT id, kind, name, external_id FROM target_scope")
def sc1_scope_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "target_scope").select("id", "kind", "name", "external_id").orderBy("id")


@query("SELECT id, name FROM target_scope WHERE kind = 'repo'")
def sc2_scope_lookup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "target_scope").filter("kind = 'repo'").select("id", "name")


@query("SELECT target_id, full_name FROM repo WHERE NOT coalesce(archived, false) AND NOT coalesce(fork, false)")
def sc4_repo_scan(spark: SparkSession, d: str) -> DataFrame:
    live = ~F.coalesce(F.col("archived"), F.lit(False)) & ~F.coalesce(F.col("fork"), F.lit(False))
    return table(spark, d, "repo").filter(live).select("target_id", "full_name").orderBy("full_name")


@query("SELECT vec_id AS chunk_id, len(embedding) AS dim FROM embeddings")
def sc5_vector_scan(spark: SparkSession, d: str) -> DataFrame:
    return vector.checked(table(spark, d, "embeddings"), 64).select(F.col("vec_id").alias("chunk_id"), F.size("embedding").cast("long").alias("dim"))


@query("SELECT id FROM chunk WHERE embed_model IS NULL")
def sc6_pending_embeds(spark: SparkSession, d: str) -> DataFrame:
    return embed.pending(table(spark, d, "chunk")).select("id")


@query("SELECT id FROM chunk WHERE summary IS NULL AND kind IN ('code','file','code_rule','commit_message')")
def sc7_pending_summaries(spark: SparkSession, d: str) -> DataFrame:
    return embed.pending_summaries(table(spark, d, "chunk")).select("id")


@query(r"SELECT CAST(regexp_extract(source_url, '/pulls?/(\d+)(?:[/#?]|$)', 1) AS BIGINT) AS pull, repo, count(*) AS n FROM artifact WHERE kind IN ('review_comment','issue_comment') AND regexp_extract(source_url, '/pulls?/(\d+)(?:[/#?]|$)', 1) <> '' GROUP BY ALL")
def sc13_comments_by_pull(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "artifact").filter(F.col("kind").isin("review_comment", "issue_comment")).withColumn("pull", scalars.pull_number(F.col("source_url")))
    return rows.filter("pull is not null").groupBy("pull", "repo").agg(F.count("*").alias("n"))


@query("SELECT id FROM artifact WHERE kind = 'pr' AND created_at > '2025-01-01'")
def sc14_newer_than_cursor(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "artifact").filter((F.col("kind") == "pr") & (F.col("created_at") > "2025-01-01")).select("id")


# Predicates


@query("SELECT c.id AS chunk_id FROM chunk c JOIN artifact a ON a.id = c.artifact_id WHERE c.kind = 'file' AND c.language = 'python' AND a.repo = 'acme/monolith'")
def pf2_filter_builder(spark: SparkSession, d: str) -> DataFrame:
    return filters.candidate_ids(table(spark, d, "chunk"), table(spark, d, "artifact"), filters.Filters(kind="file", language="python", repo="acme/monolith"))


@query("SELECT c.id FROM chunk c WHERE c.artifact_id IN (SELECT id FROM artifact WHERE decision IS NOT NULL)")
def pf3_semi_join(spark: SparkSession, d: str) -> DataFrame:
    decided = table(spark, d, "artifact").filter("decision is not null").select(F.col("id").alias("artifact_id"))
    return table(spark, d, "chunk").join(decided, "artifact_id", "left_semi").select("id")


@query("SELECT id, is_out FROM (SELECT id, regexp_matches(json_extract_string(meta_json, '$.path'), '(?s)^.*\\.min\\.js$|^vendor/.*$|^.*/vendor/.*$|^.*\\.d\\.ts$|^dist/.*$|^.*/dist/.*$|^build/.*$|^.*/build/.*$|^.*node_modules.*$|^.*\\.bundle\\.js$|^.*\\.lock$') AS is_out FROM artifact WHERE kind = 'file' AND json_valid(meta_json)) WHERE is_out")
def pf7_excluded_paths(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "artifact").filter("kind = 'file'").select("id", filters.excluded_path(F.get_json_object("meta_json", "$.path")).alias("is_out"))
    return rows.filter("is_out")


@query("SELECT id FROM chunk WHERE json_valid(context_json) AND regexp_matches(json_extract_string(context_json, '$.path'), '^[^/]*/.*s[abc].*\\.py$')")
def pf6_glob(spark: SparkSession, d: str) -> DataFrame:
    path = F.get_json_object("context_json", "$.path")
    return table(spark, d, "chunk").filter(F.coalesce(filters.matches_glob(path, "*/*s[abc]*.py"), F.lit(False))).select("id")


@query(f"SELECT id FROM artifact WHERE created_at >= '{SINCE}' AND decision IN ('approved','changes_requested','commented')")
def pf8_held_out(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "artifact").filter(filters.held_out(F.col("created_at"), SINCE) & F.col("decision").isin(*DECISIONS)).select("id")


@query(r"SELECT id FROM chunk WHERE coalesce(regexp_replace(text, '^\s+|\s+$', '', 'g'), '') <> ''")
def pf10_not_blank(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk").filter(~scalars.is_blank(F.col("text"))).select("id")


@query(f"SELECT a.id FROM artifact a WHERE a.kind = 'review_comment' AND NOT EXISTS (SELECT 1 FROM artifact b WHERE b.created_at >= '{SINCE}' AND b.source_url = a.source_url)")
def pf11_leak_filter(spark: SparkSession, d: str) -> DataFrame:
    artifacts = table(spark, d, "artifact")
    hits = artifacts.filter("kind = 'review_comment'").select("id", F.col("source_url").alias("url"))
    return filters.without_leaks(hits, artifacts, "url", SINCE).select("id")


@query("SELECT target_id, full_name FROM repo WHERE pushed_at IS NULL OR last_commits_at IS NULL OR pushed_at > last_commits_at")
def pf12_needs_walk(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "repo").filter(filters.needs_walk(F.col("pushed_at"), F.col("last_commits_at"))).select("target_id", "full_name")


@query("SELECT r.target_id, r.full_name, CASE WHEN a.repo IS NULL THEN 'gone' WHEN r.last_commits_at < '2025-01-01' THEN 'stale' END AS reason FROM repo r LEFT JOIN (SELECT DISTINCT repo FROM artifact) a ON a.repo = r.full_name")
def pf16_prune(spark: SparkSession, d: str) -> DataFrame:
    held = table(spark, d, "repo").withColumn("used_at", F.col("last_commits_at"))
    kept = table(spark, d, "artifact").select(F.col("repo").alias("full_name")).distinct()
    return filters.prune_decision(held, kept, "full_name", "2025-01-01").select("target_id", "full_name", "reason")


# Joins


@query("SELECT c.id AS chunk_id, a.id AS artifact_id, t.name AS target FROM chunk c JOIN artifact a ON a.id = c.artifact_id JOIN target_scope t ON t.id = a.target_id")
def jn1_hit_join(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "artifact").select(F.col("id").alias("artifact_id"), "target_id")
    t = table(spark, d, "target_scope").select(F.col("id").alias("target_id"), F.col("name").alias("target"))
    return table(spark, d, "chunk").select(F.col("id").alias("chunk_id"), "artifact_id").join(a, "artifact_id").join(t, "target_id").select("chunk_id", "artifact_id", "target")


@query("SELECT c.id AS chunk_id, c.kind, e.label FROM embeddings e JOIN chunk c ON c.id = e.vec_id")
def jn2_vector_join(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label")
    return table(spark, d, "chunk").select(F.col("id").alias("chunk_id"), "kind").join(e, "chunk_id")


@query("SELECT a.id AS artifact_id, c.id AS chunk_id FROM artifact a LEFT JOIN chunk c ON c.artifact_id = a.id AND c.kind = 'pr_summary' WHERE a.kind = 'pr'")
def jn5_left_pull(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunk").filter("kind = 'pr_summary'").select(F.col("id").alias("chunk_id"), "artifact_id")
    return table(spark, d, "artifact").filter("kind = 'pr'").select(F.col("id").alias("artifact_id")).join(c, "artifact_id", "left")


@query(r"SELECT a.id, CASE WHEN m.email IS NOT NULL THEN m.login WHEN regexp_extract(lower(a.author_email), '^(?:\d+\+)?([a-z0-9-]+)@users\.noreply\.', 1) <> '' THEN regexp_extract(lower(a.author_email), '^(?:\d+\+)?([a-z0-9-]+)@users\.noreply\.', 1) END AS login FROM artifact a LEFT JOIN email_login_map m ON m.email = lower(a.author_email)")
def jn9_email_login(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "email_login_map").select("email", "login", F.lit(True).alias("known"))
    rows = table(spark, d, "artifact").select("id", F.lower("author_email").alias("email")).join(m, "email", "left")
    return rows.select("id", F.when(F.col("known"), F.col("login")).otherwise(scalars.noreply_login(F.col("email"))).alias("login"))


_DISK = "SELECT json_extract_string(meta_json, '$.path') AS path, min(content_hash) AS hash FROM artifact WHERE kind = 'note' AND json_valid(meta_json) AND json_extract_string(meta_json, '$.path') IS NOT NULL"


@query(
    f"WITH held AS ({_DISK} AND target_id <= 2 GROUP BY 1), disk AS ({_DISK} AND target_id >= 2 GROUP BY 1), b AS (SELECT coalesce(d.path, h.path) AS path, d.hash AS n, h.hash AS o, d.path IS NOT NULL AS dn, h.path IS NOT NULL AS hn FROM disk d FULL JOIN held h ON h.path = d.path)"
    " SELECT path, CASE WHEN o = n THEN 'unchanged' WHEN o IS NOT NULL AND n IS NOT NULL THEN 'updated' WHEN o IS NULL AND n IN (SELECT o FROM b WHERE n IS NULL AND o IS NOT NULL) THEN 'moved' WHEN o IS NULL THEN 'added' WHEN o IN (SELECT n FROM b WHERE o IS NULL AND n IS NOT NULL) THEN 'moved away' ELSE 'deleted' END AS action FROM b"
)
def jn11_note_diff(spark: SparkSession, d: str) -> DataFrame:
    notes = table(spark, d, "artifact").filter("kind = 'note'").select("target_id", F.get_json_object("meta_json", "$.path").alias("path"), "content_hash").filter("path is not null")
    side = lambda on: notes.filter(on).groupBy("path").agg(F.min("content_hash").alias("hash"))
    return state.note_actions(side("target_id >= 2"), side("target_id <= 2"))


# Retrieval


@query(f"WITH {_TOK} SELECT (SELECT count(*) FROM tf) AS n_postings, (SELECT count(DISTINCT term) FROM tf) AS n_terms, CAST((SELECT sum(len) FROM dl) AS BIGINT) AS n_places, (SELECT count(*) FROM embeddings e JOIN chunk c ON c.id = e.vec_id) AS n_vectors")
def rt0_index(spark: SparkSession, d: str) -> DataFrame:
    """Writes the index of a corpus, where that isn't done yet; the searches below read it."""
    corpus = _corpus(spark, d)
    posts = corpus.postings().agg(F.count("*").alias("n_postings"), F.count_distinct("term").alias("n_terms"))
    return posts.crossJoin(corpus.sizes().agg(F.sum("len").alias("n_places"))).crossJoin(corpus.vectors.agg(F.count_if("known").alias("n_vectors")))


@query("WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 100 = 0), h AS (SELECT q.query_id, e.vec_id AS chunk_id, list_distance(CAST(e.embedding AS DOUBLE[]), q.qv) AS v FROM q, embeddings e) SELECT query_id, chunk_id, round(v, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY round(v, 9), chunk_id) AS rank FROM h QUALIFY rank <= 10")
def rt1_nearest(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    hits = vector.knn(vectors, vectors.filter("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id"), 10)
    return hits.select("query_id", "chunk_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_KEYS}, {_ASKED}, h AS (SELECT a.query_id, c.id AS chunk_id, list_distance(CAST(e.embedding AS DOUBLE[]), a.qv) AS v FROM asked a, embeddings e JOIN chunk c ON c.id = e.vec_id WHERE c.kind = 'review_comment'), x AS {_dedup('h', 'round(v, 9), chunk_id', 5)} SELECT query_id, chunk_id, round(v, 6) AS distance, rank FROM x")
def rt1_vector_search(spark: SparkSession, d: str) -> DataFrame:
    hits = tools.vector_search(_corpus(spark, d), _asked(spark, d), filters.Filters(kind="review_comment"))
    return hits.select("query_id", "chunk_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query("WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 100 = 0), h AS (SELECT q.query_id, e.vec_id AS chunk_id, list_distance(CAST(e.embedding AS DOUBLE[]), q.qv) AS v, row_number() OVER (PARTITION BY q.query_id ORDER BY round(list_distance(CAST(e.embedding AS DOUBLE[]), q.qv), 9), e.vec_id) AS r FROM q, embeddings e QUALIFY r <= 40) SELECT h.query_id, h.chunk_id, round(h.v, 6) AS distance, row_number() OVER (PARTITION BY h.query_id ORDER BY h.r) AS rank FROM h JOIN chunk c ON c.id = h.chunk_id WHERE c.kind = 'commit_message' QUALIFY rank <= 5")
def rt2_filter_last(spark: SparkSession, d: str) -> DataFrame:
    corpus = _corpus(spark, d)
    asked = corpus.vectors.filter("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id")
    hits = tools.vector_search(corpus, asked, filters.Filters(kind="commit_message"), mode="filter_last")
    return hits.select("query_id", "chunk_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_TOK}, {_ASKED}, {_BM25} SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 8), chunk_id) AS rank FROM bm QUALIFY rank <= 10")
def rt4_bm25(spark: SparkSession, d: str) -> DataFrame:
    corpus = _corpus(spark, d)
    phrases = text_index.phrases_of(text_index.plain_queries(_asked(spark, d)), ascii_only=True)
    hits = text_index.bm25(corpus.postings(), phrases, None, 10, corpus.n_texts(), corpus.sizes())
    return hits.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query()
def rt4_bm25_stemmed(spark: SparkSession, d: str) -> DataFrame:
    posts = text_index.postings(table(spark, d, "chunk"), "id", "text", stem=True)
    phrases = text_index.phrases_of(text_index.plain_queries(_asked(spark, d)), stem=True)
    return text_index.bm25(posts, phrases, None, 10).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


_OTHERS = ", ".join(f"('{w}', '{o}')" for w in dict.fromkeys(w for g in expand.SYNONYMS for w in g) for o in expand.alternates(w))
_WIDE = _BM25.replace("qt AS (SELECT query_id, unnest(terms) AS term, generate_subscripts(terms, 1) AS grp FROM asked)", f"syn(word, other) AS (VALUES {_OTHERS}), tk AS (SELECT query_id, unnest(terms) AS tok, generate_subscripts(terms, 1) AS grp FROM asked), qt AS (SELECT query_id, grp, tok AS term FROM tk UNION SELECT query_id, grp, other FROM tk JOIN syn ON syn.word = tk.tok UNION SELECT query_id, grp, part FROM (SELECT query_id, grp, tok, unnest(string_split(tok, '_')) AS part FROM tk) WHERE part <> '' AND part <> tok)").replace("need AS (SELECT query_id, count(*) AS n", "need AS (SELECT query_id, count(DISTINCT grp) AS n").replace("count(*) AS met", "count(DISTINCT qt.grp) AS met")


@query(f"WITH {_KEYS}, {_TOK}, {_ASKED}, {_WIDE}, found AS (SELECT query_id, chunk_id, score AS v FROM bm), x AS {_dedup('found', 'round(v, 8), chunk_id', 10)} SELECT query_id, chunk_id, round(v, 6) AS score, rank FROM x")
def rt6_expanded(spark: SparkSession, d: str) -> DataFrame:
    corpus = _corpus(spark, d)
    hits = tools.keyword_search(corpus, _asked(spark, d), filters.Filters(), 10, expander=expand.RuleExpander())
    return hits.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"{_fused('review_comment')} SELECT query_id, chunk_id, round(score, 9) AS score, round(1 - score, 9) AS distance, rank FROM rk WHERE rank <= 10")
def rt7_hybrid(spark: SparkSession, d: str) -> DataFrame:
    hits = tools.hybrid_search(_corpus(spark, d), _asked(spark, d), filters.Filters(kind="review_comment"), 10)
    return hits.select("query_id", "chunk_id", F.round("score", 9).alias("score"), F.round("distance", 9).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query(f"{_fused('commit_message', True)} SELECT query_id, chunk_id, round(score, 9) AS score, rank FROM rk WHERE rank <= 10")
def rk3_recency(spark: SparkSession, d: str) -> DataFrame:
    hits = tools.hybrid_search(_corpus(spark, d), _asked(spark, d), filters.Filters(kind="commit_message"), 10, half_life_days=365, now=NOW)
    return hits.select("query_id", "chunk_id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_KEYS}, h AS (SELECT k.chunk_id % 3 AS query_id, k.chunk_id, row_number() OVER (PARTITION BY k.chunk_id % 3 ORDER BY k.chunk_id) AS rank, akind, external_id, chunk_idx FROM keys k), o AS (SELECT query_id, chunk_id, rank FROM h QUALIFY row_number() OVER (PARTITION BY query_id, akind, external_id, chunk_idx ORDER BY rank) = 1) SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM o")
def rt8_copies(spark: SparkSession, d: str) -> DataFrame:
    chunks, artifacts = table(spark, d, "chunk"), table(spark, d, "artifact")
    keys = fusion.hit_keys(chunks, artifacts)
    hits = keys.select((F.col("chunk_id") % 3).alias("query_id"), "chunk_id")
    ranks = hits.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("chunk_id")))
    return fusion.one_of_copies(ranks, keys).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


@query(f"{_fused('review_comment')} SELECT query_id, rank, c.text AS comment, {_CUT.format(_ctx('diff_hunk'))} AS diff_hunk_context, {_ctx('path')} AS path, a.language, {_ctx('pr_title')} AS pr_title, a.repo, t.name AS target, a.source_url AS url, round(1 - score, 4) AS distance FROM rk {_HITS} WHERE rank <= 5")
def rt10_find_review_comments(spark: SparkSession, d: str) -> DataFrame:
    return tools.find_review_comments(_corpus(spark, d), _asked(spark, d)).withColumn("rank", F.col("rank").cast("long"))


@query(f"{_fused('code')} SELECT query_id, rank, {_CUT.format('c.text')} AS code_snippet, a.language, {_ctx('path')} AS path, a.repo, t.name AS target, a.source_url AS commit_url, round(1 - score, 4) AS distance FROM rk {_HITS} WHERE rank <= 5")
def rt11_find_style_examples(spark: SparkSession, d: str) -> DataFrame:
    return tools.find_style_examples(_corpus(spark, d), _asked(spark, d)).withColumn("rank", F.col("rank").cast("long"))


@query(
    f"{_fused('file')}, g AS (SELECT rk.query_id, row_number() OVER (PARTITION BY rk.query_id ORDER BY rk.rank) AS rank, {_CUT.format('c.text')} AS code_snippet, a.language, {_ctx('path')} AS path, CAST({_ctx('start_line')} AS INT) AS start_line, CAST({_ctx('end_line')} AS INT) AS end_line, c.node_kind, c.symbol_name, a.repo, t.name AS target, a.source_url AS url, round(1 - score, 4) AS distance FROM rk {_HITS} WHERE rk.rank <= 20 AND regexp_matches({_ctx('path')}, '^.*[.]py$')) SELECT * FROM g WHERE rank <= 5"
)
def rt12_find_code(spark: SparkSession, d: str) -> DataFrame:
    return tools.find_code(_corpus(spark, d), _asked(spark, d), path_glob="*.py").withColumn("rank", F.col("rank").cast("long"))


@query(f"{_fused('code_rule')} SELECT query_id, rank, c.text AS rule, {_ctx('language')} AS language, {_ctx('examples')} AS examples, t.name AS target, round(1 - score, 4) AS distance FROM rk {_HITS} WHERE rank <= 5")
def rt13_find_applicable_rules(spark: SparkSession, d: str) -> DataFrame:
    return tools.find_applicable_rules(_corpus(spark, d), _asked(spark, d)).withColumn("rank", F.col("rank").cast("long"))


@query(
    f"WITH {_KEYS}, {_ASKED}, h AS (SELECT a.query_id, c.id AS chunk_id, list_distance(CAST(e.embedding AS DOUBLE[]), a.qv) AS v FROM asked a, embeddings e JOIN chunk c ON c.id = e.vec_id WHERE c.kind = 'pr_summary'), x AS {_dedup('h', 'round(v, 9), chunk_id', 20)},"
    " w AS (SELECT x.query_id, coalesce(sum(1.0::DOUBLE / (1 + x.v)) FILTER (a.decision = 'approved'), 0) AS wa, coalesce(sum(1.0::DOUBLE / (1 + x.v)) FILTER (a.decision = 'changes_requested'), 0) AS wr, coalesce(sum(1.0::DOUBLE / (1 + x.v)) FILTER (a.decision = 'commented'), 0) AS wc, count(*) AS n_pulled, count(*) FILTER (a.decision IN ('approved','changes_requested','commented')) AS n_with_decision FROM x JOIN chunk c ON c.id = x.chunk_id JOIN artifact a ON a.id = c.artifact_id JOIN target_scope t ON t.id = a.target_id GROUP BY ALL)"
    " SELECT query_id, CASE WHEN greatest(wa, wr, wc) <= 0 THEN 'unknown' WHEN round(wa, 12) = round(greatest(wa, wr, wc), 12) THEN 'approved' WHEN round(wr, 12) = round(greatest(wa, wr, wc), 12) THEN 'changes_requested' ELSE 'commented' END AS prediction, CASE WHEN wa + wr + wc > 0 THEN round(greatest(wa, wr, wc) / (wa + wr + wc), 4) ELSE 0 END AS confidence, round(wa, 4) AS weight_approved, round(wr, 4) AS weight_changes_requested, round(wc, 4) AS weight_commented, n_pulled, n_with_decision FROM w"
)
def rt14_predict_review_outcome(spark: SparkSession, d: str) -> DataFrame:
    return tools.predict_review_outcome(_corpus(spark, d), _asked(spark, d))[0]


@query(f"SELECT id, {_CUT.format('text')} AS snippet FROM chunk")
def rt16_snippets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk").select("id", scalars.truncated(F.col("text")).alias("snippet"))


# Windows


@query("SELECT id, external_id FROM (SELECT *, row_number() OVER (PARTITION BY kind, external_id ORDER BY target_id NULLS FIRST, id) AS rn FROM artifact WHERE kind = 'rule') WHERE rn = 1")
def wn1_first_rules(spark: SparkSession, d: str) -> DataFrame:
    return rules.first_copies(table(spark, d, "artifact"), "rule").select("id", "external_id")


@query("SELECT id AS chunk_id, row_number() OVER (PARTITION BY artifact_id ORDER BY id) AS chunk_idx FROM chunk")
def wn3_chunk_index(spark: SparkSession, d: str) -> DataFrame:
    return fusion.chunk_index(table(spark, d, "chunk")).withColumn("chunk_idx", F.col("chunk_idx").cast("long"))


_REVIEWS = "rv AS (SELECT id AS artifact_id, unnest(CAST(json_extract(meta_json, '$.reviewer_decisions[*]') AS JSON[])) AS r, generate_subscripts(CAST(json_extract(meta_json, '$.reviewer_decisions[*]') AS JSON[]), 1) AS pos FROM artifact WHERE kind = 'pr' AND json_valid(meta_json))"


@query(f"WITH {_REVIEWS}, x AS (SELECT artifact_id, pos, json_extract_string(r, '$.login') AS login, json_extract_string(r, '$.state') AS state, coalesce(json_extract_string(r, '$.submitted_at'), '') AS submitted_at FROM rv) SELECT artifact_id, login, state, submitted_at FROM x WHERE login IS NOT NULL QUALIFY row_number() OVER (PARTITION BY artifact_id, login ORDER BY submitted_at DESC, pos) = 1")
def wn4_latest_reviews(spark: SparkSession, d: str) -> DataFrame:
    return rules.latest_reviews(table(spark, d, "artifact"))


@query("SELECT repo, id FROM artifact WHERE kind = 'commit' AND repo IS NOT NULL QUALIFY row_number() OVER (PARTITION BY repo ORDER BY created_at DESC NULLS LAST, id) <= 3")
def rk9_first_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "artifact").filter("kind = 'commit' and repo is not null")
    return rules.first_rows(rows, 3, "repo", F.desc_nulls_last("created_at"), F.col("id")).select("repo", "id")


@query("SELECT a.repo, CASE WHEN json_valid(c.context_json) THEN json_extract_string(c.context_json, '$.path') END AS path, count(*) AS n, min(c.id) AS first_chunk, max(c.id) AS last_chunk FROM chunk c JOIN artifact a ON a.id = c.artifact_id WHERE c.kind = 'file' GROUP BY ALL")
def wn7_file_pages(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "artifact").select(F.col("id").alias("artifact_id"), "repo")
    rows = table(spark, d, "chunk").filter("kind = 'file'").join(a, "artifact_id")
    return rows.groupBy("repo", F.get_json_object("context_json", "$.path").alias("path")).agg(F.count("*").alias("n"), F.min("id").alias("first_chunk"), F.max("id").alias("last_chunk"))


# Rollups


@query("SELECT kind, count(*) AS n FROM artifact GROUP BY kind")
def ag1_artifacts(spark: SparkSession, d: str) -> DataFrame:
    return rollups.counted(table(spark, d, "artifact"), "kind")


@query("SELECT c.kind, count(*) AS n FROM chunk c JOIN artifact a ON a.id = c.artifact_id WHERE a.target_id = 2 GROUP BY c.kind")
def ag2_chunks(spark: SparkSession, d: str) -> DataFrame:
    return rollups.counted(rollups.in_target(table(spark, d, "chunk"), table(spark, d, "artifact"), 2), "kind")


@query("SELECT language, count(*) AS n FROM artifact WHERE language IS NOT NULL GROUP BY language")
def ag3_languages(spark: SparkSession, d: str) -> DataFrame:
    return rollups.languages(table(spark, d, "artifact"))


@query("SELECT (SELECT count(*) FROM chunk WHERE embed_model IS NULL) AS pending_embed, (SELECT count(*) FROM embeddings WHERE vec_id IN (SELECT id FROM chunk)) AS vectors")
def ag4_pending(spark: SparkSession, d: str) -> DataFrame:
    return rollups.pending(table(spark, d, "chunk"), table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id")))


@query("SELECT repo AS full_name, author_login, n FROM (SELECT repo, author_login, count(*) AS n FROM artifact WHERE author_login IS NOT NULL AND repo IN (SELECT full_name FROM repo) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY repo ORDER BY n DESC, author_login) <= 10")
def ag5_repo_authors(spark: SparkSession, d: str) -> DataFrame:
    repos = table(spark, d, "repo").dropDuplicates(["full_name"])
    rows = rollups.repo_overview(repos, table(spark, d, "artifact"), table(spark, d, "chunk"))
    return rows.select("full_name", F.explode("top_authors").alias("a")).select("full_name", "a.author_login", "a.n")


@query("SELECT repo AS full_name, path, n FROM (SELECT a.repo, json_extract_string(c.context_json, '$.path') AS path, count(*) AS n FROM chunk c JOIN artifact a ON a.id = c.artifact_id WHERE json_valid(c.context_json) AND json_extract_string(c.context_json, '$.path') IS NOT NULL AND a.repo IN (SELECT full_name FROM repo) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY repo ORDER BY n DESC, path) <= 10")
def ag5_repo_paths(spark: SparkSession, d: str) -> DataFrame:
    repos = table(spark, d, "repo").dropDuplicates(["full_name"])
    rows = rollups.repo_overview(repos, table(spark, d, "artifact"), table(spark, d, "chunk"))
    return rows.select("full_name", F.explode("top_paths").alias("a")).select("full_name", "a.path", "a.n")


@query("SELECT author_login, count(*) AS n FROM artifact WHERE kind = 'review_comment' AND author_login IS NOT NULL AND target_id = 2 GROUP BY 1 HAVING count(*) >= 2")
def ag6_authors(spark: SparkSession, d: str) -> DataFrame:
    return rollups.authors_of(table(spark, d, "artifact"), 2, 2)


@query("SELECT DISTINCT full_name FROM repo")
def ag7_repos(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "repo").select("full_name").distinct()


@query("SELECT kind, count(*) FILTER (summary IS NOT NULL) AS done, count(*) AS total, round(100.0::DOUBLE * count(*) FILTER (summary IS NOT NULL) / count(*), 4) AS pct FROM chunk WHERE kind IN ('code','file','code_rule','commit_message') GROUP BY kind")
def ag8_summary_coverage(spark: SparkSession, d: str) -> DataFrame:
    return rollups.summary_coverage(table(spark, d, "chunk"), SUMMARIZABLE)


@query("SELECT count(embed_model) AS embedded, count(*) AS total, round(100.0::DOUBLE * count(embed_model) / count(*), 4) AS pct FROM chunk")
def ag9_embed_coverage(spark: SparkSession, d: str) -> DataFrame:
    return rollups.embed_coverage(table(spark, d, "chunk"))


@query("SELECT target_id, count(*) AS n_total, count(*) FILTER (NOT coalesce(archived, false)) AS n_active, count(*) FILTER (coalesce(archived, false)) AS n_archived, count(*) FILTER (NOT coalesce(archived, false) AND last_commits_at IS NOT NULL) AS commits, count(*) FILTER (NOT coalesce(archived, false) AND last_files_at IS NOT NULL) AS files, count(*) FILTER (NOT coalesce(archived, false) AND last_reviews_at IS NOT NULL) AS reviews FROM repo GROUP BY target_id")
def ag10_cursor_progress(spark: SparkSession, d: str) -> DataFrame:
    return rollups.cursor_progress(table(spark, d, "repo"))


_OUT = "o AS (SELECT a.id, CAST(1 + a.id % 3 AS INT) AS tier, CASE a.id % 2 WHEN 0 THEN 'hybrid' ELSE 'bm25' END AS mode, coalesce(a.decision = 'approved', false) AS passed FROM artifact a WHERE a.decision IS NOT NULL)"


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "artifact").filter("decision is not null").select("id", (1 + F.col("id") % 3).cast("int").alias("tier"), F.when(F.col("id") % 2 == 0, "hybrid").otherwise("bm25").alias("mode"), (F.col("decision") == "approved").alias("passed"))


@query(f"WITH {_OUT} SELECT tier, mode, count(*) FILTER (passed) AS passed, count(*) AS total FROM o GROUP BY ROLLUP (tier, mode)")
def ag14_pass_rates(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.pass_rates(_outcomes(spark, d), "tier", "mode")


@query(f"WITH {_OUT}, r AS (SELECT tier, count(*) FILTER (passed)::DOUBLE / count(*) AS rate, CASE tier WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.85::DOUBLE ELSE 0.7::DOUBLE END AS goal FROM o WHERE mode = 'hybrid' GROUP BY tier) SELECT tier, round(rate, 6) AS rate, goal, rate >= goal AS met, tier = 1 AND rate < goal AS fails FROM r")
def ag16_gate(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.gate(_outcomes(spark, d))


_PRED = "p AS (SELECT decision AS truth, CASE id % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'commented' WHEN 2 THEN 'changes_requested' END AS prediction FROM artifact WHERE decision IS NOT NULL)"


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    rest = F.col("id") % 4
    return table(spark, d, "artifact").filter("decision is not null").select(F.col("decision").alias("truth"), F.when(rest == 0, "approved").when(rest == 1, "commented").when(rest == 2, "changes_requested").alias("prediction"))


@query(f"WITH {_PRED} SELECT avg(CASE WHEN truth = prediction THEN 1.0::DOUBLE ELSE 0 END) AS accuracy, count(*) AS n FROM p")
def ag19_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.accuracy(_predicted(spark, d))


@query(f"WITH {_PRED}, c(class) AS (VALUES ('approved'), ('changes_requested'), ('commented')) SELECT class, coalesce(round(2.0::DOUBLE * count(*) FILTER (truth = class AND prediction = class) / nullif(count(*) FILTER (truth = class) + count(*) FILTER (prediction = class), 0), 6), 0) AS f1 FROM c, p GROUP BY class")
def ag20_f1(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.class_f1(_predicted(spark, d))


@query("SELECT decision AS class, round(count(*)::DOUBLE / (SELECT count(decision) FROM artifact), 6) AS share FROM artifact WHERE decision IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1")
def ag21_majority(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.majority(_predicted(spark, d))


@query(f"SELECT count(*) FILTER (kind = 'review_comment' AND created_at >= '{SINCE}') AS review_comments, count(*) FILTER (kind = 'pr' AND created_at >= '{SINCE}' AND decision IN ('approved','changes_requested','commented')) AS decisioned_prs FROM artifact")
def ag22_eligibility(spark: SparkSession, d: str) -> DataFrame:
    return rollups.eligibility(table(spark, d, "artifact"), SINCE, DECISIONS)


@query("WITH b AS (SELECT kind, count(*) AS n FROM artifact WHERE target_id <= 2 GROUP BY 1), a AS (SELECT kind, count(*) AS n FROM artifact WHERE target_id >= 2 GROUP BY 1) SELECT kind, coalesce(a.n, 0) - coalesce(b.n, 0) AS added FROM b FULL JOIN a USING (kind)")
def ag23_delta(spark: SparkSession, d: str) -> DataFrame:
    artifacts = table(spark, d, "artifact")
    side = lambda on: rollups.counted(artifacts.filter(on), "kind")
    return rollups.delta(side("target_id <= 2"), side("target_id >= 2"), "kind")


@query("SELECT t.id AS target_id, t.name, t.kind AS target_kind, count(a.id) AS total, " + ", ".join(f"count(*) FILTER (a.kind = '{k}') AS {k}" for k in ARTIFACT_KINDS) + " FROM target_scope t LEFT JOIN artifact a ON a.target_id = t.id GROUP BY ALL")
def ag24_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return rollups.snapshot(table(spark, d, "target_scope"), table(spark, d, "artifact"), ARTIFACT_KINDS)


@query("SELECT repo, kind, max(created_at) AS newest FROM artifact GROUP BY ALL")
def ag26_newest(spark: SparkSession, d: str) -> DataFrame:
    return rollups.newest(table(spark, d, "artifact"), "created_at", "repo", "kind")


@query("SELECT label, sha1(array_to_string(list_sort(list(vec_id)), ',')) AS signature FROM embeddings GROUP BY label")
def ag13_signature(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").groupBy("label").agg(rules.sample_signature(F.collect_list("vec_id")).alias("signature"))


def _markdown(kind: str, title: str) -> str:
    rows = f"(SELECT c.id, c.text AS rule, c.language, c.context_json FROM chunk c JOIN (SELECT id FROM artifact WHERE kind = 'rule' QUALIFY row_number() OVER (PARTITION BY kind, external_id ORDER BY target_id NULLS FIRST, id) = 1) a ON a.id = c.artifact_id WHERE c.kind = '{kind}' ORDER BY c.id LIMIT 50)"
    quotes = "coalesce(array_to_string(list_transform(CASE WHEN json_valid(context_json) THEN CAST(json_extract(context_json, '$.examples') AS VARCHAR[]) END, lambda q: chr(10) || '  > ' || q), ''), '')"
    section = f"SELECT language, '## ' || coalesce(language, 'General') || chr(10) || chr(10) || string_agg('- ' || rule || {quotes}, chr(10) ORDER BY id) AS s FROM {rows} GROUP BY language"
    return f"(SELECT '# {title}' || chr(10) || chr(10) || coalesce(string_agg(s, chr(10) || chr(10) ORDER BY language IS NULL, language), '') FROM ({section}))"


_N_RULES = "(SELECT count(*) FROM (SELECT c.id FROM chunk c JOIN (SELECT id FROM artifact WHERE kind = 'rule' QUALIFY row_number() OVER (PARTITION BY kind, external_id ORDER BY target_id NULLS FIRST, id) = 1) a ON a.id = c.artifact_id WHERE c.kind = '{0}' LIMIT 50))"


@query(f"SELECT {_markdown('rule', 'Review rules')} || chr(10) || chr(10) || {_markdown('code_rule', 'Code rules')} AS markdown, {_N_RULES.format('rule')} AS review_rules, {_N_RULES.format('code_rule')} AS code_rules")
def ag28_house_rules(spark: SparkSession, d: str) -> DataFrame:
    return rules.house_rules(table(spark, d, "chunk"), table(spark, d, "artifact"))


@query()
def ag0_status(spark: SparkSession, d: str) -> DataFrame:
    return rollups.status(table(spark, d, "target_scope"), table(spark, d, "repo"), table(spark, d, "artifact"), table(spark, d, "chunk"), table(spark, d, "embeddings"), "acme/monolith")


# Set operations


@query("SELECT DISTINCT external_id FROM artifact WHERE kind = 'commit' AND (target_id = 2 OR author_login IS NULL)")
def so1_union(spark: SparkSession, d: str) -> DataFrame:
    commits = table(spark, d, "artifact").filter("kind = 'commit'")
    return commits.filter("target_id = 2").select("external_id").union(commits.filter("author_login is null").select("external_id")).distinct()


@query("SELECT DISTINCT repo FROM artifact WHERE repo IS NOT NULL EXCEPT SELECT full_name FROM repo")
def so4_difference(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "artifact").filter("repo is not null").select("repo").distinct().join(table(spark, d, "repo").select(F.col("full_name").alias("repo")), "repo", "left_anti")


@query("SELECT vec_id AS id FROM embeddings INTERSECT SELECT id FROM chunk WHERE kind = 'file'")
def so3_intersection(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id")).intersect(table(spark, d, "chunk").filter("kind = 'file'").select("id"))


# Scalars


@query("SELECT id, sha256(coalesce(kind, '') || chr(0) || coalesce(external_id, '') || chr(0) || coalesce(author_login, '')) AS hash FROM artifact")
def sf3_content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "artifact").select("id", scalars.nul_hash(F.col("kind"), F.col("external_id"), F.col("author_login")).alias("hash"))


@query("WITH r AS (SELECT id, text, regexp_replace(left(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 60), '-+$', '') AS b FROM chunk WHERE kind IN ('rule','code_rule')) SELECT id, CASE WHEN b = '' THEN left(sha1(text), 8) ELSE b || '-' || left(sha1(text), 8) END AS slug FROM r")
def sf6_rule_slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk").filter(F.col("kind").isin("rule", "code_rule")).select("id", scalars.rule_slug(F.col("text")).alias("slug"))


@query("SELECT target_id, full_name, regexp_replace(regexp_replace(replace(lower(full_name), '/', '__'), '[^a-z0-9_]+', '-', 'g'), '^[-_]+|[-_]+$', '', 'g') AS slug FROM repo")
def sf6_repo_slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "repo").select("target_id", "full_name", scalars.repo_slug(F.col("full_name")).alias("slug"))


@query(r"SELECT id, len(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS n FROM chunk WHERE text IS NOT NULL")
def sf8_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk").filter("text is not null").select("id", F.size(scalars.word_tokens(F.col("text"))).cast("long").alias("n"))


@query(r"SELECT id, len(l) AS n_parts, l[1] AS first_part FROM (SELECT id, list_sort(list_distinct(list_filter(string_split(regexp_replace(lower(regexp_replace(regexp_replace(symbol_name, '([A-Z])([A-Z][a-z])', '\1_\2', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g')), '[_-]+', '_', 'g'), '_'), lambda p: p <> '' AND p <> lower(symbol_name)))) AS l FROM chunk WHERE symbol_name IS NOT NULL)")
def sf7_compounds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk").filter("symbol_name is not null").select("id", scalars.compound_parts(F.col("symbol_name")).alias("parts")).select("id", F.size("parts").cast("long").alias("n_parts"), F.get("parts", F.lit(0)).alias("first_part"))


@query(r"SELECT id, us FROM (SELECT *, epoch_us(TRY_CAST(CASE WHEN regexp_matches(created_at, '(Z|[+-][0-9][0-9]:?[0-9][0-9])$') THEN created_at ELSE created_at || '+00:00' END AS TIMESTAMPTZ)) AS us FROM artifact) WHERE regexp_matches(created_at, '^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:?\d{2})?$') AND us IS NOT NULL")
def sf12_iso_times(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "artifact").select("id", F.unix_micros(scalars.iso_timestamp(F.col("created_at"))).alias("us")).filter("us is not null")


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(greatest(0, list_cosine_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def sf15_cosine(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("w"))
    return e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("v")).join(b, "a").select("a", "b", F.round(vector.cosine(F.col("v"), F.col("w")), 6).alias("distance"))


@query(r"SELECT id, CAST(regexp_extract(source_url, '/pulls?/(\d+)(?:[/#?]|$)', 1) AS BIGINT) AS pull FROM artifact WHERE regexp_extract(source_url, '/pulls?/(\d+)(?:[/#?]|$)', 1) <> ''")
def sf21_pull_number(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "artifact").select("id", scalars.pull_number(F.col("source_url")).alias("pull")).filter("pull is not null")


_GET = {k: f"CASE WHEN json_valid(context_json) THEN json_extract_string(context_json, '$.{k}') END AS {k.replace('symbol_name', 'symbol').replace('leading_doc', 'doc')}" for k in ("path", "symbol_name", "node_kind", "leading_doc", "repo", "commit_sha", "pr_number", "title")}
_LINE = "CASE WHEN {0} <> '' THEN '# ' || {0} || chr(10) ELSE '' END"


@query(
    f"WITH g AS (SELECT id, kind, summary, {', '.join(_GET.values()).replace('AS node_kind', 'AS node')} FROM chunk), h AS (SELECT *, array_to_string(list_filter([CASE WHEN repo <> '' THEN repo END, '#' || pr_number], lambda x: x IS NOT NULL), ' ') AS parts, CASE WHEN title <> '' THEN title ELSE path END AS named FROM g)"
    f" SELECT id, CASE WHEN kind IN ('code', 'code_rule', 'file') THEN CASE WHEN symbol <> '' AND node <> '' THEN '# ' || CASE WHEN path <> '' THEN path ELSE '<unknown>' END || ' :: ' || symbol || ' (' || node || ')' || chr(10) || {_LINE.format('summary')} || {_LINE.format('doc')} || chr(10) WHEN path <> '' OR summary <> '' THEN {_LINE.format('path')} || {_LINE.format('summary')} || chr(10) ELSE '' END"
    f" WHEN kind = 'commit_message' THEN CASE WHEN repo <> '' OR commit_sha <> '' THEN '# commit ' || CASE WHEN repo <> '' THEN repo ELSE '?' END || '@' || CASE WHEN commit_sha <> '' THEN left(commit_sha, 7) ELSE '?' END || chr(10) || {_LINE.format('summary')} || chr(10) ELSE '' END"
    " WHEN kind = 'review_comment' THEN CASE WHEN parts <> '' THEN '# review on ' || parts || CASE WHEN path <> '' THEN ' (' || path || ')' ELSE '' END || chr(10) || chr(10) ELSE '' END"
    " WHEN kind = 'note' THEN CASE WHEN named <> '' THEN '# note: ' || named || chr(10) || chr(10) ELSE '' END ELSE '' END AS header FROM h"
)
def sf26_headers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk").select("id", scalars.header(F.col("kind"), F.col("context_json"), F.col("summary")).alias("header"))


@query(r"SELECT id, regexp_replace(regexp_replace(text, '(?i)bearer\s+[A-Za-z0-9._\-+/=]+', 'Bearer ***', 'g'), '(?i)(x-api-key[\x22'']?\s*[:=]\s*[\x22'']?)[A-Za-z0-9._\-+/=]+', '\1***', 'g') AS masked FROM chunk")
def sf28_redact_log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk").select("id", scalars.redact_log(F.col("text")).alias("masked"))


# Chunkers


_LINES = "SELECT doc_id, string_split(regexp_replace(text, chr(10) || '$', ''), chr(10)) AS l FROM documents WHERE text <> ''"


@query(f"WITH x AS ({_LINES}), w AS (SELECT doc_id AS id, l, unnest(range(0, CAST(70 * ceil(greatest(len(l) - 80, 0) / 70.0) AS BIGINT) + 1, 70)) AS p FROM x WHERE len(l) >= 3) SELECT id, p + 1 AS start_line, least(p + 80, len(l)) AS end_line, array_to_string(list_slice(l, p + 1, p + 80), chr(10)) AS text FROM w WHERE least(p + 80, len(l)) - p >= 3")
def ch4_line_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = chunkers.line_windows(table(spark, d, "documents"), "doc_id", "text")
    return rows.select("id", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "text")


_HUNK = "h AS (SELECT id, CASE WHEN json_valid(context_json) THEN json_extract_string(context_json, '$.diff_hunk') END AS hunk FROM chunk WHERE kind = 'review_comment')"


def _hunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk").filter("kind = 'review_comment'").select("id", F.get_json_object("context_json", "$.diff_hunk").alias("hunk"))


@query(
    f"WITH {_HUNK}, l AS (SELECT id, unnest(string_split(hunk, chr(10))) AS line, generate_subscripts(string_split(hunk, chr(10)), 1) AS pos FROM h WHERE hunk IS NOT NULL), a AS (SELECT *, pos - row_number() OVER (PARTITION BY id ORDER BY pos) AS isl FROM l WHERE starts_with(line, '+') AND NOT starts_with(line, '+++')), p AS (SELECT *, (row_number() OVER (PARTITION BY id, isl ORDER BY pos) - 1) // 80 AS part FROM a), b AS (SELECT id, isl, part, min(pos) AS f, count(*) AS n_lines, string_agg(substr(line, 2), chr(10) ORDER BY pos) AS text FROM p GROUP BY ALL HAVING count(*) >= 3) SELECT id, row_number() OVER (PARTITION BY id ORDER BY f) AS block, n_lines, text FROM b"
)
def ch2_added_blocks(spark: SparkSession, d: str) -> DataFrame:
    return chunkers.added_blocks(_hunks(spark, d), "id", "hunk").withColumn("block", F.col("block").cast("long"))


@query()
def ch1_hunks(spark: SparkSession, d: str) -> DataFrame:
    path = F.coalesce(F.get_json_object("context_json", "$.path"), F.lit("unknown"))
    rows = table(spark, d, "chunk").filter("kind = 'review_comment'").withColumn("hunk", F.get_json_object("context_json", "$.diff_hunk")).filter("hunk is not null")
    return chunkers.diff_hunks(rows.withColumn("diff", F.concat(F.lit("+++ b/"), path, F.lit("\n"), F.col("hunk"))), "id", "diff")


@query()
def ch5_file_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunkers.file_chunks(table(spark, d, "documents").filter("path is not null"), "doc_id", "text", F.lower("lang"))


@query()
def ch6_diff_chunks(spark: SparkSession, d: str) -> DataFrame:
    path = F.coalesce(F.get_json_object("context_json", "$.path"), F.lit("unknown"))
    rows = table(spark, d, "chunk").filter("kind = 'review_comment'").withColumn("hunk", F.get_json_object("context_json", "$.diff_hunk")).filter("hunk is not null")
    return chunkers.diff_chunks(rows.withColumn("diff", F.concat(F.lit("+++ b/"), path, F.lit("\n"), F.col("hunk"))), "id", "diff")


_T, _B = r"regexp_replace(coalesce(pr_title, ''), '^\s+|\s+$', '', 'g')", r"regexp_replace(left(coalesce(truth_comment, ''), 2000), '^\s+|\s+$', '', 'g')"


@query(f"SELECT item_id, CASE WHEN {_T} <> '' AND {_B} <> '' THEN {_T} || chr(10) || chr(10) || {_B} WHEN {_T} <> '' THEN {_T} WHEN {_B} <> '' THEN {_B} END AS summary FROM review_holdout")
def ch9_pull_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "review_holdout").select("item_id", chunkers.pull_summary(F.col("pr_title"), F.col("truth_comment")).alias("summary"))


@query(r"SELECT id, m FROM (SELECT id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS m FROM chunk WHERE kind = 'commit_message') WHERE length(m) >= 20")
def ch10_commit_messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk").filter("kind = 'commit_message'").select("id", chunkers.commit_message(F.col("text")).alias("m")).filter("m is not null")


@query()
def ch11_note_windows(spark: SparkSession, d: str) -> DataFrame:
    return chunkers.note_chunks(table(spark, d, "documents").filter(scalars.strip(F.lower("source")).isin("note", "runbook", "release")), "doc_id", "text")


# Changes and streams


_KEY = "target_id, kind, external_id"


@query(
    "WITH old AS (SELECT * FROM artifact WHERE id % 10 <> 0 QUALIFY row_number() OVER (PARTITION BY target_id, kind, external_id ORDER BY id) = 1), new AS (SELECT * FROM artifact WHERE id % 10 = 0 QUALIFY row_number() OVER (PARTITION BY target_id, kind, external_id ORDER BY id DESC) = 1)"
    " SELECT coalesce(n.target_id, o.target_id) AS target_id, coalesce(n.kind, o.kind) AS kind, coalesce(n.external_id, o.external_id) AS external_id, o.id IS NOT NULL AS known, CASE WHEN n.id IS NOT NULL THEN n.decision ELSE o.decision END AS decision FROM old o FULL JOIN new n ON n.target_id IS NOT DISTINCT FROM o.target_id AND n.kind IS NOT DISTINCT FROM o.kind AND n.external_id IS NOT DISTINCT FROM o.external_id"
)
def up3_upsert_artifacts(spark: SparkSession, d: str) -> DataFrame:
    artifacts = table(spark, d, "artifact")
    keys = ["target_id", "kind", "external_id"]
    old = state.last_of(artifacts.filter("id % 10 <> 0"), keys, F.col("id"))
    new = artifacts.filter("id % 10 = 0").withColumn("_seq", F.col("id")).drop("id")
    merged = state.upsert_artifacts(old, new, seq="_seq")
    # What was known keeps its id, what is new has one after the greatest.
    top = old.agg(F.max("id").alias("_top"))
    return merged.crossJoin(F.broadcast(top)).select(*keys, (F.col("id") <= F.col("_top")).alias("known"), "decision")


@query(
    "WITH old AS (SELECT * FROM artifact WHERE id % 10 <> 0), k AS (SELECT target_id, kind, external_id, content_hash FROM old QUALIFY row_number() OVER (PARTITION BY target_id, kind, external_id ORDER BY id DESC) = 1) SELECT n.id, CASE WHEN k.kind IS NULL THEN 'added' WHEN k.content_hash = n.content_hash THEN 'unchanged' ELSE 'changed' END AS action FROM artifact n LEFT JOIN k ON k.target_id = n.target_id AND k.kind = n.kind AND k.external_id = n.external_id WHERE n.id % 10 = 0"
)
def st6_hash_skip(spark: SparkSession, d: str) -> DataFrame:
    artifacts = table(spark, d, "artifact")
    old = artifacts.filter("id % 10 <> 0")
    new = artifacts.filter("id % 10 = 0").withColumnRenamed("id", "_new")
    return state.split_by_hash(new, old).select(F.col("_new").alias("id"), "action")


@query("SELECT r.target_id, r.full_name, coalesce(n.at, r.last_commits_at) AS last_commits_at FROM repo r LEFT JOIN (SELECT repo, max(created_at) AS at FROM artifact WHERE kind = 'commit' GROUP BY 1) n ON n.repo = r.full_name")
def up5_repo_cursor(spark: SparkSession, d: str) -> DataFrame:
    repos = table(spark, d, "repo")
    newest = table(spark, d, "artifact").filter("kind = 'commit'").groupBy(F.col("repo").alias("full_name")).agg(F.max("created_at").alias("last_commits_at"))
    cursors = repos.select("target_id", "full_name").join(newest, "full_name")
    return state.set_repo_cursor(repos, cursors).select("target_id", "full_name", "last_commits_at")


@query("SELECT id FROM chunk WHERE artifact_id NOT IN (SELECT id FROM artifact WHERE target_id = 4)")
def up9_delete_scope(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return state.delete_target(4, table(spark, d, "target_scope"), table(spark, d, "repo"), table(spark, d, "artifact"), table(spark, d, "chunk"), vectors)[3].select("id")


@query("SELECT e.vec_id AS chunk_id, round(CASE WHEN e.vec_id % 2 = 0 THEN -e.embedding[1] ELSE e.embedding[1] END, 5) AS first_number, CASE WHEN e.vec_id % 2 = 0 THEN 'label' ELSE c.embed_model END AS embed_model FROM embeddings e JOIN chunk c ON c.id = e.vec_id")
def up10_write_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of even ids are replaced, and their chunks marked."""
    old = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    new = old.filter("chunk_id % 2 = 0").withColumn("embedding", F.transform("embedding", lambda x: -x))
    vectors, chunks = state.write_vectors(old, table(spark, d, "chunk"), new, "label")
    return vectors.join(chunks.select(F.col("id").alias("chunk_id"), "embed_model"), "chunk_id").select("chunk_id", F.round(F.col("embedding")[0], 5).alias("first_number"), "embed_model")


@query("WITH w AS (SELECT n.id, n.path, n.text FROM (SELECT c.id, json_extract_string(c.context_json, '$.path') AS path, c.text FROM chunk c WHERE c.kind = 'note' AND json_valid(c.context_json)) n WHERE path IS NOT NULL), e AS (SELECT path, min(text) AS text FROM w WHERE id % 3 <> 0 GROUP BY 1), h AS (SELECT path, max(text) AS text, max(id) % 5 <> 0 AS generated FROM w WHERE id % 3 <> 1 GROUP BY 1) SELECT coalesce(e.path, h.path) AS path, CASE WHEN h.path IS NULL THEN 'written' WHEN e.path IS NULL AND generated THEN 'removed' WHEN NOT generated THEN 'adopted' WHEN e.text = h.text THEN 'unchanged' ELSE 'written' END AS action FROM e FULL JOIN h ON h.path = e.path")
def sk1_page_actions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunk").filter("kind = 'note'").select("id", F.get_json_object("context_json", "$.path").alias("path"), "text").filter("path is not null")
    want = rows.filter("id % 3 <> 0").groupBy("path").agg(F.min("text").alias("text"))
    have = rows.filter("id % 3 <> 1").groupBy("path").agg(F.max("text").alias("text"), (F.max("id") % 5 != 0).alias("generated"))
    return state.page_actions(want, have)


@query("SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n_events, count(DISTINCT user_id) AS n_users FROM events GROUP BY ALL")
def st0_activity(spark: SparkSession, d: str) -> DataFrame:
    return sync.activity(table(spark, d, "events"), "ts")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n_events FROM s GROUP BY user_id, n")
def st0_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sync.sessions(table(spark, d, "events"), "ts")


@query("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 1 DAY")
def st5_overlap_pad(spark: SparkSession, d: str) -> DataFrame:
    return sync.cursor_filter(table(spark, d, "events"), "ts", "2024-01-10 00:00:00", 1).select("event_id")


@query("SELECT max(ts) + INTERVAL 1 SECOND AS cursor FROM events")
def st3_next_cursor(spark: SparkSession, d: str) -> DataFrame:
    return sync.next_cursor(table(spark, d, "events"), "ts")


# More scalars and changes


@query("SELECT id, len(list_distinct(list_transform(CAST(json_extract(emails_json, '$') AS VARCHAR[]), lambda x: lower(x)))) AS n FROM target_scope WHERE emails_json IS NOT NULL")
def so6_email_sets(spark: SparkSession, d: str) -> DataFrame:
    emails = F.transform(F.from_json("emails_json", "array<string>"), F.lower)
    return table(spark, d, "target_scope").filter("emails_json is not null").select("id", F.size(F.array_union(emails, F.array_except(emails, F.array().cast("array<string>")))).cast("long").alias("n"))


@query(r"SELECT id, greatest(0, (epoch_us(TIMESTAMPTZ '2026-06-01T00:00:00Z') - us) / 8.64e10) AS days FROM (SELECT id, created_at, epoch_us(TRY_CAST(CASE WHEN regexp_matches(created_at, '(Z|[+-][0-9][0-9]:?[0-9][0-9])$') THEN created_at ELSE created_at || '+00:00' END AS TIMESTAMPTZ)) AS us FROM artifact) WHERE regexp_matches(created_at, '^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$') AND us IS NOT NULL")
def sf13_age_days(spark: SparkSession, d: str) -> DataFrame:
    then = scalars.iso_timestamp(F.col("created_at"))
    return table(spark, d, "artifact").select("id", scalars.age_days(then, F.to_timestamp(F.lit(NOW))).alias("days")).filter("days is not null")


@query("SELECT id, CASE WHEN w IN ('approved','changes_requested','commented') THEN w WHEN w IN ('changes','change','request_changes','request') THEN 'changes_requested' WHEN w = 'approve' THEN 'approved' WHEN w = 'comment' THEN 'commented' END AS decision FROM (SELECT id, regexp_replace(string_split(string_split(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g'), chr(10))[1], ' ')[1], '^[.,:;\"''`*]+|[.,:;\"''`*]+$', '', 'g') AS w FROM chunk WHERE kind = 'review_comment' AND text IS NOT NULL)")
def sf24_decisions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk").filter("kind = 'review_comment' and text is not null").select("id", scalars.decision_of(F.col("text")).alias("decision"))


@query(
    r"WITH a AS (SELECT id, coalesce(list_filter(list_transform(string_split_regex(summary, '\r\n|\r|\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')[1], '') AS s FROM chunk WHERE summary IS NOT NULL), b AS (SELECT id, regexp_replace(s, '^(- )?(\* )?(• )?(1\. )?(Description: )?(Summary: )?', '') AS s FROM a), c AS (SELECT id, CASE WHEN length(s) >= 2 AND left(s, 1) = right(s, 1) AND left(s, 1) IN (chr(34), chr(39), '`') THEN s[2:-2] ELSE s END AS s FROM b)"
    r" SELECT id, regexp_replace(CASE WHEN length(s) > 320 THEN regexp_replace(left(s, 320), ' [^ ]*$', '') || '…' ELSE s END, '^\s+|\s+$', '', 'g') AS summary FROM c"
)
def sf25_clean_summaries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk").filter("summary is not null").select("id", scalars.clean_summary(F.col("summary")).alias("summary"))


@query("WITH n AS (SELECT full_name, min(target_id) AS target_id, max(pushed_at) AS pushed_at FROM repo GROUP BY full_name) SELECT r.target_id, r.full_name, CASE WHEN n.full_name IS NOT NULL THEN n.pushed_at ELSE r.pushed_at END AS pushed_at, r.last_commits_at FROM repo r LEFT JOIN n ON n.target_id = r.target_id AND n.full_name = r.full_name")
def up2_upsert_repo(spark: SparkSession, d: str) -> DataFrame:
    repos = table(spark, d, "repo")
    new = repos.groupBy("full_name").agg(F.min("target_id").alias("target_id"), F.max("pushed_at").alias("pushed_at"))
    return state.upsert_repo(repos, new).select("target_id", "full_name", "pushed_at", "last_commits_at")


@query("WITH o AS (SELECT * FROM artifact QUALIFY row_number() OVER (PARTITION BY target_id, kind, external_id ORDER BY id) = 1), n AS (SELECT * FROM artifact QUALIFY row_number() OVER (PARTITION BY target_id, kind, external_id ORDER BY id DESC) = 1) SELECT o.id, coalesce(n.decision, o.decision) AS decision, coalesce(n.author_login, o.author_login) AS author_login FROM o LEFT JOIN n ON n.target_id = o.target_id AND n.kind = o.kind AND n.external_id = o.external_id")
def up4_metadata(spark: SparkSession, d: str) -> DataFrame:
    keys = ["target_id", "kind", "external_id"]
    artifacts = table(spark, d, "artifact").select("id", *keys, "decision", "author_login")
    old, new = state.last_of(artifacts, keys, F.col("id")), state.last_of(artifacts, keys, F.desc("id")).drop("id")
    return state.update_metadata(old, new).select("id", "decision", "author_login")


@query("SELECT id, CASE WHEN kind = 'file' THEN NULL WHEN summary IS NULL AND kind = 'code' THEN 's: ' || regexp_replace(text, '\\s+$', '', 'g') ELSE summary END AS summary FROM chunk")
def up11_summaries(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunk")
    new = chunks.filter("summary is null and kind = 'code'").select("id", F.concat(F.lit("s: "), "text").alias("summary"))
    return state.clear_summaries(state.write_summaries(chunks, new), ("file",)).select("id", "summary")


@query("SELECT id, updated FROM (SELECT id, json_extract_string(meta_json, '$.state') AS st, created_at AS updated, CASE id % 3 WHEN 0 THEN NULL ELSE '2025-01-01' END AS cur, id % 5 AS fresh FROM artifact WHERE kind = 'pr' AND json_valid(meta_json)) WHERE cur IS NULL OR fresh > 3 OR coalesce(st <> 'open' AND updated > cur, false)")
def pf13_needs_review(spark: SparkSession, d: str) -> DataFrame:
    pulls = table(spark, d, "artifact").filter("kind = 'pr'").select("id", F.get_json_object("meta_json", "$.state").alias("st"), F.col("created_at").alias("updated"), F.when(F.col("id") % 3 != 0, "2025-01-01").alias("cur"), (F.col("id") % 5).alias("fresh"), "meta_json")
    pulls = pulls.filter(F.try_parse_json("meta_json").isNotNull())
    return pulls.filter(filters.needs_review(F.col("cur"), F.col("updated"), F.col("st"), F.greatest(F.col("fresh") - 3, F.lit(0)))).select("id", "updated")


@query("SELECT c.id AS chunk_id, coalesce(json_extract_string(a.meta_json, '$.title'), '') AS title FROM chunk c LEFT JOIN (SELECT * FROM artifact WHERE json_valid(meta_json)) a ON a.id = c.artifact_id WHERE c.kind = 'pr_summary'")
def jn10_pull_titles(spark: SparkSession, d: str) -> DataFrame:
    meta = table(spark, d, "artifact").select(F.col("id").alias("artifact_id"), F.get_json_object("meta_json", "$.title").alias("title"))
    rows = table(spark, d, "chunk").filter("kind = 'pr_summary'").select(F.col("id").alias("chunk_id"), "artifact_id").join(meta, "artifact_id", "left")
    return rows.select("chunk_id", F.coalesce("title", F.lit("")).alias("title"))


@query("SELECT author_login, count(*) AS n FROM artifact WHERE author_login IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def rk6_top_authors(spark: SparkSession, d: str) -> DataFrame:
    return rollups.top_groups(table(spark, d, "artifact"), F.col("author_login"), "author_login")


@query("SELECT id FROM artifact ORDER BY coalesce(created_at, '') DESC, id LIMIT 20")
def rk5_most_recent(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "artifact").orderBy(F.coalesce("created_at", F.lit("")).desc(), "id").limit(20).select("id")


_SIGNS = ", ".join(f"('{sign}', '{language}')" for sign, language in languages.BY_SIGN.items())


@query(f"WITH m(sign, language) AS (VALUES {_SIGNS}), n AS (SELECT id, regexp_extract(coalesce(CASE WHEN json_valid(context_json) THEN json_extract_string(context_json, '$.path') END, 'unknown'), '[^/]*$') AS name FROM chunk WHERE kind = 'review_comment') SELECT n.id, coalesce(a.language, b.language) AS language FROM n LEFT JOIN m a ON a.sign = n.name LEFT JOIN m b ON b.sign = regexp_extract(n.name, '[.][^.]*$')")
def sf23_diff_language(spark: SparkSession, d: str) -> DataFrame:
    path = F.coalesce(F.get_json_object("context_json", "$.path"), F.lit("unknown"))
    rows = table(spark, d, "chunk").filter("kind = 'review_comment'").select("id", F.concat(F.lit("+++ b/"), path, F.lit("\n")).alias("diff"))
    return rows.select("id", languages.language_of_diff(F.col("diff")).alias("language"))


# Clusters, rules, evaluation


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.lit("all").alias("scope"), F.col("label").cast("long").alias("cluster_id"), F.col("vec_id").alias("chunk_id"))


@query(
    "WITH m AS (SELECT e.label, c.id, c.language, a.repo FROM embeddings e JOIN chunk c ON c.id = e.vec_id LEFT JOIN artifact a ON a.id = c.artifact_id), l AS (SELECT label, language, count(*) AS n, min(id) AS f FROM m WHERE language IS NOT NULL GROUP BY ALL), t AS (SELECT label, language, n, sum(n) OVER (PARTITION BY label) AS al FROM l QUALIFY row_number() OVER (PARTITION BY label ORDER BY n DESC, f) = 1)"
    " SELECT m.label AS cluster_id, 'rule-' || left(sha1(array_to_string(list_sort(list(m.id)), ',')), 16) AS external_id, count(*) AS cluster_size, any_value(CASE WHEN t.n >= 0.6::DOUBLE * t.al THEN t.language END) AS language, array_to_string(list_sort(list(DISTINCT m.repo) FILTER (m.repo IS NOT NULL)), ',') AS repos FROM m LEFT JOIN t ON t.label = m.label GROUP BY m.label"
)
def ag11_cluster_facts(spark: SparkSession, d: str) -> DataFrame:
    facts = cluster.cluster_facts(_labelled(spark, d), table(spark, d, "chunk"), table(spark, d, "artifact"))
    return facts.select("cluster_id", "external_id", "cluster_size", "language", F.array_join("member_repos", ",").alias("repos"))


@query("SELECT count(*) AS n, round(avg(d), 6) AS mean, round(max(d), 6) AS most FROM (SELECT greatest(0, list_cosine_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS d FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)")
def ag17_mean_distance(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    pairs = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("v")).join(e.select((F.col("vec_id") - 1).alias("a"), F.col("embedding").alias("w")), "a")
    return pairs.select(vector.cosine(F.col("v"), F.col("w")).alias("d")).agg(F.count("*").alias("n"), F.round(F.avg("d"), 6).alias("mean"), F.round(F.max("d"), 6).alias("most"))


@query("WITH x AS (SELECT id % 7 AS tool, decision = 'approved' AS passed FROM artifact WHERE decision IS NOT NULL) SELECT tool, count(*) FILTER (passed) AS passed, count(*) AS total FROM x GROUP BY tool")
def ag15_rates_by_tool(spark: SparkSession, d: str) -> DataFrame:
    rows = _outcomes(spark, d).withColumn("tool", F.col("id") % 7)
    return evaluate.pass_rates(rows, "tool").filter("tool is not null")


@query(f"WITH {_REVIEWS}, x AS (SELECT artifact_id, json_extract_string(r, '$.login') AS login, lower(json_extract_string(r, '$.state')) AS state, coalesce(json_extract_string(r, '$.submitted_at'), '') AS t FROM rv), o AS (SELECT login FROM x WHERE login IS NOT NULL GROUP BY login ORDER BY count(*) DESC, login LIMIT 1), z AS (SELECT x.artifact_id, x.state FROM x JOIN o USING (login) QUALIFY row_number() OVER (PARTITION BY artifact_id ORDER BY t DESC, json_extract_string('\"' || upper(state) || '\"', '$') DESC) = 1) SELECT artifact_id, state AS decision FROM z WHERE state IN ('approved','changes_requested','commented')")
def wn5_reviewer_decision(spark: SparkSession, d: str) -> DataFrame:
    artifacts = table(spark, d, "artifact").filter("kind = 'pr'")
    schema = "struct<reviewer_decisions:array<struct<login:string,state:string,submitted_at:string>>>"
    said = artifacts.select(F.explode(F.from_json("meta_json", schema)["reviewer_decisions"]["login"]).alias("login")).filter("login is not null")
    login = rollups.top_groups(said, F.col("login"), "login", 1).first()
    decision = tools.reviewer_decision(F.col("meta_json"), login["login"] if login else "")
    return artifacts.select(F.col("id").alias("artifact_id"), decision.alias("decision")).filter("decision is not null")


@query("SELECT id FROM chunk WHERE (json_valid(context_json) AND contains(json_extract_string(context_json, '$.path'), '.py')) OR contains(lower(text), 'cursor') OR symbol_name = 'x'")
def pf15_expectation(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunk").withColumn("path", F.get_json_object("context_json", "$.path"))
    return rows.filter(filters.expectation([{"path_substr": ".py"}, {"text_substr": "Cursor"}, {"symbol_name": "x"}])).select("id")


@query("SELECT id, coalesce(node_kind, CASE WHEN json_valid(context_json) THEN json_extract_string(context_json, '$.node_kind') END) AS node_kind, coalesce(symbol_name, CASE WHEN json_valid(context_json) THEN json_extract_string(context_json, '$.symbol_name') END) AS symbol_name FROM chunk")
def up7_promoted(spark: SparkSession, d: str) -> DataFrame:
    return lookup.promoted(table(spark, d, "chunk")).select("id", "node_kind", "symbol_name")


@query("SELECT r.target_id, r.full_name, coalesce(n.at, r.pushed_at) AS pushed_at FROM repo r LEFT JOIN (SELECT repo, max(created_at) AS at FROM artifact GROUP BY 1) n ON n.repo = r.full_name")
def jn12_enriched_repos(spark: SparkSession, d: str) -> DataFrame:
    pushed = table(spark, d, "artifact").select(F.col("repo").alias("full_name"), F.col("created_at").alias("pushed_at"))
    return lookup.with_pushed(table(spark, d, "repo"), pushed).select("target_id", "full_name", "pushed_at")


@query("SELECT id, CASE WHEN json_valid(context_json) THEN CAST(json_extract_string(context_json, '$.start_line') AS INT) END AS start_line, CASE WHEN json_valid(context_json) THEN json_extract_string(context_json, '$.path') END AS path FROM chunk WHERE kind = 'file'")
def sf1_context_fields(spark: SparkSession, d: str) -> DataFrame:
    get = lambda k: F.get_json_object("context_json", f"$.{k}")
    return table(spark, d, "chunk").filter("kind = 'file'").select("id", get("start_line").cast("int").alias("start_line"), get("path").alias("path"))


@query("SELECT id, CASE WHEN json_valid(c.context_json) THEN json_extract_string(c.context_json, '$.path') END AS path, regexp_extract(json_extract_string(c.context_json, '$.path'), '[.]([a-z]+)$', 1) AS ending FROM chunk c WHERE json_valid(c.context_json) AND regexp_matches(json_extract_string(c.context_json, '$.path'), '[.](py|go|rs|ts|js)$')")
def sf22_code_paths(spark: SparkSession, d: str) -> DataFrame:
    path = F.get_json_object("context_json", "$.path")
    names = {"python": "py", "go": "go", "rust": "rs", "typescript": "ts", "javascript": "js"}
    rows = table(spark, d, "chunk").select("id", path.alias("path")).filter("path is not null").withColumn("language", languages.language_of_path(F.col("path")))
    ending = F.element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), F.col("language"))
    return rows.select("id", "path", ending.alias("ending")).filter("ending is not null")


@query()
def sk1_rule_pages(spark: SparkSession, d: str) -> DataFrame:
    return vault.rule_pages(rules.list_rules(table(spark, d, "chunk"), table(spark, d, "artifact"), limit=None))


@query()
def sk1_file_pages(spark: SparkSession, d: str) -> DataFrame:
    return vault.file_pages(table(spark, d, "chunk"), table(spark, d, "artifact"))


@query()
def cl3_comment_clusters(spark: SparkSession, d: str) -> DataFrame:
    corpus = _corpus(spark, d)
    return models.cluster_review_comments(corpus.chunks, corpus.artifacts, corpus.vectors)


@query()
def cl2_clusters(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, "embeddings").select(F.lit("all").alias("scope"), F.col("vec_id").alias("chunk_id"), "embedding")
    return cluster.clusters(points)


@query()
def ds1_distilled_rules(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunk")
    points = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding").join(chunks.select(F.col("id").alias("chunk_id"), F.col("kind").alias("scope")), "chunk_id")
    members = cluster.clusters(points)
    facts = cluster.cluster_facts(members, chunks, table(spark, d, "artifact"))
    return cluster.extractive_rules(points, members, facts, chunks).select("scope", "external_id", "cluster_size", "language", "rule")


@query("SELECT c.id, c.text AS rule, c.language FROM chunk c JOIN (SELECT id FROM artifact WHERE kind = 'rule' QUALIFY row_number() OVER (PARTITION BY kind, external_id ORDER BY target_id NULLS FIRST, id) = 1) a ON a.id = c.artifact_id WHERE c.kind = 'rule' ORDER BY c.id LIMIT 20")
def ds2_list_rules(spark: SparkSession, d: str) -> DataFrame:
    return rules.list_rules(table(spark, d, "chunk"), table(spark, d, "artifact")).select("id", "rule", "language")


@query("SELECT c.id, a.author_login, coalesce(a.created_at, '') AS created_at FROM chunk c JOIN (SELECT * FROM artifact WHERE kind = 'review_comment' QUALIFY row_number() OVER (PARTITION BY kind, external_id ORDER BY target_id NULLS FIRST, id) = 1) a ON a.id = c.artifact_id WHERE c.kind = 'review_comment'")
def ds4_recent_comments(spark: SparkSession, d: str) -> DataFrame:
    return rules.recent_comments(table(spark, d, "chunk"), table(spark, d, "artifact"), limit=None).select("id", "author_login", "created_at")


@query(
    "WITH a AS (SELECT * FROM artifact WHERE kind = 'review_comment' QUALIFY row_number() OVER (PARTITION BY kind, external_id ORDER BY target_id NULLS FIRST, id) = 1), r AS (SELECT a.author_login, c.id, left(c.text, 600) AS t FROM chunk c JOIN a ON a.id = c.artifact_id WHERE c.kind = 'review_comment' AND a.author_login IS NOT NULL QUALIFY row_number() OVER (PARTITION BY a.author_login ORDER BY coalesce(a.created_at, '') DESC, c.id) <= 50)"
    " SELECT author_login, '# ' || author_login || chr(10) || chr(10) || coalesce(string_agg('> ' || t, chr(10) || chr(10) ORDER BY id), '') AS profile_md, count(*) AS n_samples, sha1(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id)) AS sample_hash FROM r GROUP BY author_login"
)
def ds5_developer_profiles(spark: SparkSession, d: str) -> DataFrame:
    return rules.developer_profile(table(spark, d, "chunk"), table(spark, d, "artifact"))


@query(r"SELECT a.id AS artifact_id, c.id AS chunk_id, a.created_at FROM artifact a JOIN chunk c ON c.artifact_id = a.id AND c.kind = 'review_comment' WHERE a.kind = 'review_comment' AND a.created_at >= '" + SINCE + r"' AND regexp_replace(c.text, '^\s+|\s+$', '', 'g') <> '' AND json_valid(c.context_json) AND regexp_replace(json_extract_string(c.context_json, '$.diff_hunk'), '^\s+|\s+$', '', 'g') <> ''")
def ev1_held_out_comments(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.held_out_comments(table(spark, d, "artifact"), table(spark, d, "chunk"), SINCE).select("artifact_id", "chunk_id", "created_at")


@query(f"SELECT a.id AS artifact_id, c.id AS chunk_id, a.decision AS truth FROM artifact a LEFT JOIN chunk c ON c.artifact_id = a.id AND c.kind = 'pr_summary' WHERE a.kind = 'pr' AND a.created_at >= '{SINCE}' AND a.decision IN ('approved','changes_requested','commented')")
def ev2_held_out_pulls(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.held_out_pulls(table(spark, d, "artifact"), table(spark, d, "chunk"), SINCE).select("artifact_id", "chunk_id", "truth")


_EVERY = _fused("review_comment").replace("c.kind = 'review_comment' AND ", "").replace(" WHERE c.kind = 'review_comment'", "")


@query(
    f"{_EVERY}, nv AS (SELECT a.query_id, c.id AS chunk_id, list_distance(CAST(e.embedding AS DOUBLE[]), a.qv) AS v FROM asked a, embeddings e JOIN chunk c ON c.id = e.vec_id), vv AS {_dedup('nv', 'round(v, 9), chunk_id', 5)}, hit AS (SELECT query_id, chunk_id, 'vector' AS mode FROM vv UNION ALL SELECT query_id, chunk_id, 'bm25' FROM bl WHERE rank <= 5 UNION ALL SELECT query_id, chunk_id, 'hybrid' FROM rk WHERE rank <= 5), ok AS (SELECT DISTINCT query_id, mode FROM hit WHERE chunk_id = query_id), q AS (SELECT query_id, 1 + query_id % 3 AS tier, m.mode FROM asked CROSS JOIN (VALUES ('vector'), ('bm25'), ('hybrid')) m(mode))"
    " SELECT q.tier, q.mode, count(*) FILTER (ok.query_id IS NOT NULL) AS passed, count(*) AS total FROM q LEFT JOIN ok ON ok.query_id = q.query_id AND ok.mode = q.mode GROUP BY ROLLUP (q.tier, q.mode)"
)
def ev3_search_quality(spark: SparkSession, d: str) -> DataFrame:
    corpus, asked = _corpus(spark, d), _asked(spark, d)
    found = None
    for mode, hits in tools.all_modes(corpus, asked, filters.Filters()).items():
        rows = hits.groupBy("query_id").agg(F.max(F.col("chunk_id") == F.col("query_id")).alias("passed")).withColumn("mode", F.lit(mode))
        found = rows if found is None else found.unionByName(rows)
    modes = asked.select("query_id", (1 + F.col("query_id") % 3).alias("tier"), F.explode(F.array(*map(F.lit, ("vector", "bm25", "hybrid")))).alias("mode"))
    return evaluate.pass_rates(modes.join(found, ["query_id", "mode"], "left").fillna(False, ["passed"]), "tier", "mode")


@query()
def ev5_predictions(spark: SparkSession, d: str) -> DataFrame:
    corpus = _corpus(spark, d)
    pulls = evaluate.held_out_pulls(corpus.artifacts, corpus.chunks, SINCE).select("chunk_id", "truth")
    asked = corpus.vectors.join(pulls, "chunk_id").select(F.col("chunk_id").alias("query_id"), F.lit("").alias("query"), "embedding")
    said = tools.predict_review_outcome(corpus, asked)[0].select(F.col("query_id").alias("chunk_id"), "prediction")
    return evaluate.class_f1(pulls.join(said, "chunk_id"))


@query("SELECT id, count(*) AS n_chunks, sum(length(text)) AS n_chars FROM (SELECT artifact_id AS id, text FROM chunk) GROUP BY id")
def ud6_chunk_sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk").groupBy(F.col("artifact_id").alias("id")).agg(F.count("*").alias("n_chunks"), F.sum(F.char_length("text")).cast("long").alias("n_chars"))


@query()
def ud1_embedded(spark: SparkSession, d: str) -> DataFrame:
    return embed.embed(embed.pending(table(spark, d, "chunk")), embed.HashEmbedder()).select("chunk_id", F.round(vector.dot(F.col("embedding"), F.col("embedding")), 4).alias("norm"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Fused search for review comments."""
    return tools.find_review_comments(_corpus(spark, d), _asked(spark, d))


from corvane.plans import more, parts  # noqa: E402,F401  they register their queries here
