"""More queries: sources by way of landing folders, scalars, state, stores, reports and banks."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import expand, scalars
from corvane.operators import chunkers, embed, evaluate, filters, lookup, models, report, state, tools, vault
from corvane.plans.queries import _ASKED, _asked, _corpus, _fused, query, sql
from corvane.runtime import durable, shared_dir
from corvane.sources import banks, landing
from corvane.sources.tables import table
from corvane.streaming import sync

_STARTED = "2026-01-01T00:00:00Z"


def _landing(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/corvane/{name}-{uuid.uuid4().hex}"


# Sources


@query("SELECT id, kind, name FROM target_scope WHERE id = 1")
def sc3_one_scope(spark: SparkSession, d: str) -> DataFrame:
    row = lookup.one_scope(table(spark, d, "target_scope"), id=1)
    return spark.createDataFrame([(row["id"], row["kind"], row["name"])], "id int, kind string, name string")


_LOG = "SELECT a.external_id AS sha, coalesce(a.created_at, '') AS date, lower(coalesce(a.author_email, '')) AS email, CASE WHEN a.id % 5 = 0 THEN 2 ELSE 1 END AS n_parents, regexp_replace(c.text, '\\s+$', '') AS message FROM artifact a JOIN chunk c ON c.artifact_id = a.id WHERE a.kind = 'commit' AND c.kind = 'commit_message' AND c.text IS NOT NULL AND a.external_id IS NOT NULL"


@query(f"SELECT sha, date, email, message FROM ({_LOG}) WHERE n_parents = 1 AND date >= '2025-01-01'")
def sc8_git_log(spark: SparkSession, d: str) -> DataFrame:
    """Commits as a log of records and fields, written and read again; merges and old ones are out."""
    commits = table(spark, d, "artifact").filter("kind = 'commit' and external_id is not null")
    said = table(spark, d, "chunk").filter("kind = 'commit_message' and text is not null").select("artifact_id", "text")
    parents = F.when(F.col("id") % 5 == 0, "p1 p2").otherwise("p1")
    rows = commits.join(said, commits["id"] == said["artifact_id"])
    log = rows.select(F.concat_ws("\u001f", "external_id", F.coalesce("created_at", F.lit("")), F.coalesce("author_email", F.lit("")), parents, "text").alias("value"))
    path = _landing(spark, "log")
    log.write.option("lineSep", "\u001e").text(path)
    return landing.git_log(spark, path, since="2025-01-01").select("sha", "date", "email", "message")


@query("SELECT a.external_id AS sha, c.text AS diff FROM artifact a JOIN chunk c ON c.artifact_id = a.id WHERE c.kind = 'code' AND c.text IS NOT NULL AND a.external_id IS NOT NULL")
def sc9_git_show(spark: SparkSession, d: str) -> DataFrame:
    made_by = table(spark, d, "artifact").filter("external_id is not null").select(F.col("id").alias("artifact_id"), "external_id")
    rows = table(spark, d, "chunk").filter("kind = 'code' and text is not null").join(made_by, "artifact_id")
    path = _landing(spark, "show")
    rows.select(F.concat_ws("\u001f", "external_id", "text").alias("value")).write.option("lineSep", "\u001e").text(path)
    return landing.git_show(spark, path)


@query("SELECT id, kind, external_id FROM artifact")
def sc11_pages(spark: SparkSession, d: str) -> DataFrame:
    """Artifacts as pages of an interface, some arrays and some objects with items."""
    items = F.to_json(F.collect_list(F.struct("id", "kind", "external_id")))
    rows = table(spark, d, "artifact").groupBy((F.col("id") % 50).alias("page")).agg(items.alias("_items"))
    path = _landing(spark, "pages")
    rows.select("page", F.when(F.col("page") % 2 == 0, F.concat(F.lit('{"items":'), "_items", F.lit("}"))).otherwise(F.col("_items")).alias("value")).write.partitionBy("page").text(path)
    return landing.pages(spark, path, "struct<id:long,kind:string,external_id:string>")


_PAGES = "p AS (SELECT full_name || '/' || target_id AS url, x.page, CASE WHEN x.page = 1 THEN head_sha END AS etag FROM repo, (VALUES (1), (2), (3)) x(page))"


@query(f"WITH {_PAGES} SELECT p.url, p.page FROM p WHERE p.url NOT IN (SELECT full_name || '/' || target_id FROM repo WHERE head_sha IS NOT NULL AND NOT coalesce(archived, false))")
def sc12_changed_listings(spark: SparkSession, d: str) -> DataFrame:
    """Listings whose first page has the tag of before are left out; those of archived ones changed."""
    repos = table(spark, d, "repo").select(F.concat_ws("/", "full_name", "target_id").alias("url"), "head_sha", "archived")
    pages = repos.select("url", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("page"), "head_sha").withColumn("etag", F.when(F.col("page") == 1, F.col("head_sha")))
    seen = repos.select("url", F.when(F.coalesce("archived", F.lit(False)), F.lit("older")).otherwise(F.col("head_sha")).alias("etag"))
    return landing.changed_listings(pages, seen).select("url", "page")


@query("SELECT kind, id, external_id, decision FROM artifact WHERE kind IS NOT NULL")
def sc16_cache(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "artifact").filter("kind is not null").select("kind", "id", "external_id", "decision")
    path = _landing(spark, "cache")
    landing.write_cache(rows, path, "kind")
    landing.write_cache(rows.filter("kind = 'pr'"), path, "kind")
    return landing.read_cache(spark, path, "kind", "struct<id:long,external_id:string,decision:string>")


def _bank(spark: SparkSession, d: str) -> list[dict]:
    """A bank of the held-out examples (a table of fixed size), as its file would say it."""
    rows = table(spark, d, "review_holdout").select("item_id", "artifact_id", "truth_comment").orderBy("item_id").collect()
    words = [expand.re.findall(r"[a-z0-9_]+", (r["truth_comment"] or "").lower())[:3] for r in rows]
    entries = [{"query": " ".join(w), "tool": "find_review_comments", "tier": 1 + r["item_id"] % 3, "label": str(r["item_id"]), "expect_any": [{"artifact_id": r["artifact_id"]}, {"text_substr": (r["truth_comment"] or "")[:12]}]} for w, r in zip(words, rows)]
    return banks.parse_bank(json.dumps({"queries": entries}))


_ENTRIES = "b AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS query_id, item_id, artifact_id, coalesce(truth_comment, '') AS said FROM review_holdout)"


@query(f"WITH {_ENTRIES} SELECT query_id, array_to_string(list_slice(regexp_extract_all(lower(said), '[a-z0-9_]+'), 1, 3), ' ') AS query, 'find_review_comments' AS tool, CAST(1 + item_id % 3 AS INT) AS tier, CAST(item_id AS VARCHAR) AS label FROM b")
def sc17_bank(spark: SparkSession, d: str) -> DataFrame:
    return banks.bank_table(spark, _bank(spark, d))


_BANK_ASKED = f"{_ENTRIES}, asked AS (SELECT b.query_id, list_slice(regexp_extract_all(lower(b.said), '[a-z0-9_]+'), 1, 3) AS terms, CAST(e.embedding AS DOUBLE[]) AS qv FROM b JOIN embeddings e ON e.vec_id = b.query_id + 1)"
_BANK_LEGS = _fused("review_comment").replace(_ASKED, _BANK_ASKED)


@query(
    f"{_BANK_LEGS}, hit AS (SELECT query_id, chunk_id, 'vector' AS mode FROM vl WHERE rank <= 5 UNION ALL SELECT query_id, chunk_id, 'bm25' FROM bl WHERE rank <= 5 UNION ALL SELECT query_id, chunk_id, 'hybrid' FROM rk WHERE rank <= 5), ok AS (SELECT DISTINCT h.query_id, h.mode FROM hit h JOIN b USING (query_id) JOIN chunk c ON c.id = h.chunk_id JOIN artifact a ON a.id = c.artifact_id JOIN target_scope t ON t.id = a.target_id WHERE c.artifact_id = b.artifact_id OR contains(lower(c.text), lower(left(b.said, 12))))"
    " SELECT CAST(1 + item_id % 3 AS INT) AS tier, m.mode, count(*) FILTER (ok.query_id IS NOT NULL) AS passed, count(*) AS total FROM b CROSS JOIN (VALUES ('vector'), ('bm25'), ('hybrid')) m(mode) LEFT JOIN ok ON ok.query_id = b.query_id AND ok.mode = m.mode GROUP BY ALL"
)
def jn13_bank_runs(spark: SparkSession, d: str) -> DataFrame:
    """A bank in every mode, and its pass rates by tier and mode."""
    entries = _bank(spark, d)
    vectors = table(spark, d, "embeddings").select((F.col("vec_id") - 1).alias("query_id"), "embedding")
    asked = banks.bank_table(spark, entries).select("query_id", "query").join(vectors, "query_id")
    runs = evaluate.run_bank(_corpus(spark, d), entries, asked)
    return runs.groupBy("tier", "mode").agg(F.count_if("passed").alias("passed"), F.count("*").alias("total"))


# Lookups and stores


@query("SELECT EXISTS (SELECT 1 FROM chunk) AS has_chunks, EXISTS (SELECT 1 FROM embeddings) AS has_vectors, EXISTS (SELECT 1 FROM artifact WHERE id = -1) AS has_missing")
def pf5_probes(spark: SparkSession, d: str) -> DataFrame:
    corpus = _corpus(spark, d)
    tools.require_data(corpus)
    found = [not t.isEmpty() for t in (corpus.chunks, corpus.vectors, corpus.artifacts.filter("id = -1"))]
    return spark.createDataFrame([tuple(found)], "has_chunks boolean, has_vectors boolean, has_missing boolean")


@query("SELECT 'personal' AS scope, min(id) AS target_id FROM target_scope WHERE kind = 'user' UNION ALL SELECT 'project', (SELECT min(id) FROM target_scope WHERE kind = 'repo' AND name = (SELECT min(name) FROM target_scope WHERE kind = 'repo')) UNION ALL SELECT 'given', 3")
def pf14_scopes(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "target_scope")
    name = targets.filter("kind = 'repo'").agg(F.min("name")).first()[0]
    found = [("personal", tools.resolve_scope(targets, "personal").target_id), ("project", tools.resolve_scope(targets, "project", name).target_id), ("given", tools.resolve_scope(targets, "personal", name, 3).target_id)]
    return spark.createDataFrame(found, "scope string, target_id int")


@query(sql()["rt1_vector_search"])
def rt9_exact_store(spark: SparkSession, d: str) -> DataFrame:
    hits = tools.vector_store("exact").search(_corpus(spark, d), _asked(spark, d), filters.Filters(kind="review_comment"), 5)
    return hits.select("query_id", "chunk_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query("SELECT min(id) AS id, external_id FROM artifact WHERE kind = 'commit' AND external_id IS NOT NULL GROUP BY external_id")
def wn6_first_commits(spark: SparkSession, d: str) -> DataFrame:
    return state.first_seen(table(spark, d, "artifact").filter("kind = 'commit'"), "external_id", F.col("id")).select("id", "external_id")


@query("SELECT e.vec_id AS chunk_id, c.language, a.repo FROM embeddings e JOIN chunk c ON c.id = e.vec_id JOIN artifact a ON a.id = c.artifact_id WHERE c.kind = 'review_comment' AND a.repo = (SELECT repo FROM artifact WHERE repo IS NOT NULL GROUP BY repo ORDER BY count(*) DESC, repo LIMIT 1)")
def cl1_members(spark: SparkSession, d: str) -> DataFrame:
    artifacts, chunks = table(spark, d, "artifact"), table(spark, d, "chunk")
    repo = artifacts.filter("repo is not null").groupBy("repo").count().orderBy(F.desc("count"), "repo").first()["repo"]
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    ids = models.cluster_members("review_comment", chunks, artifacts, vectors, repo=repo)
    facts = chunks.select(F.col("id").alias("chunk_id"), "language", "artifact_id").join(artifacts.select(F.col("id").alias("artifact_id"), "repo"), "artifact_id")
    return ids.join(facts, "chunk_id").select("chunk_id", "language", "repo")


# Scalars


@query("SELECT id, CAST(json_object('kind', kind, 'repo', repo, 'decision', decision) AS VARCHAR) AS said FROM artifact")
def sf2_compact_json(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "artifact").select("id", scalars.compact_json(F.struct("kind", "repo", "decision")).alias("said"))


@query("SELECT full_name, target_id, split_part(full_name, '/', 1) AS owner, split_part(full_name, '/', 2) AS name, true AS same FROM repo WHERE full_name IS NOT NULL")
def sf20_origins(spark: SparkSession, d: str) -> DataFrame:
    of = lambda before, after: scalars.origin_parts(F.concat(F.lit(before), F.col("full_name"), F.lit(after)))
    rows = table(spark, d, "repo").filter("full_name is not null").select("full_name", "target_id", of("https://git.acme.example/", ".git").alias("a"), of("git@git.acme.example:", ".git").alias("b"), of("ssh://git@git.acme.example/", "").alias("c"))
    return rows.select("full_name", "target_id", "a.owner", "a.name", ((F.col("a") == F.col("b")) & (F.col("a") == F.col("c"))).alias("same"))


@query("SELECT id, nullif(regexp_extract(coalesce(meta_json, ''), '\\{.*\\}', 0, 's'), '') AS block FROM artifact")
def sf27_json_blocks(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit("Here it is:\n```\n"), F.coalesce("meta_json", F.lit("")), F.lit("\n```\nThat is all."))
    return table(spark, d, "artifact").select("id", scalars.json_block(said).alias("block"))


@query("SELECT id, kind, coalesce(repo, 'none') AS repo, '---' || chr(10) || 'kind: ' || kind || chr(10) || 'repo: ' || coalesce(repo, 'none') || chr(10) || '---' || chr(10) || coalesce(external_id, '') AS text FROM artifact WHERE kind IS NOT NULL")
def sf29_front_matter(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "artifact").filter("kind is not null")
    meta = F.create_map(F.lit("repo"), F.coalesce("repo", F.lit("none")), F.lit("kind"), F.col("kind"))
    rows = rows.select("id", scalars.formatted_front_matter(meta, F.coalesce("external_id", F.lit(""))).alias("text"))
    back = scalars.front_matter(F.col("text"))
    return rows.select("id", F.element_at(back, "kind").alias("kind"), F.element_at(back, "repo").alias("repo"), "text")


@query(
    "SELECT id, CASE WHEN n >= 1073741824 THEN format('{:.1f} GB', floor(n / 1073741824.0 * 10 + 0.5) / 10) WHEN n >= 1048576 THEN format('{:.1f} MB', floor(n / 1048576.0 * 10 + 0.5) / 10) WHEN n >= 1024 THEN format('{:.1f} KB', floor(n / 1024.0 * 10 + 0.5) / 10) ELSE n || ' B' END AS size,"
    " CASE WHEN s >= 3600 THEN s // 3600 || 'h ' || (s % 3600) // 60 || 'm' WHEN s >= 60 THEN s // 60 || 'm ' || s % 60 || 's' ELSE s || 's' END AS took FROM (SELECT id, CAST(id AS BIGINT) * id * 7 AS n, CAST(id AS BIGINT) * 7 AS s FROM artifact)"
)
def sf30_human(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "artifact").select("id", scalars.human_bytes(F.col("id") * F.col("id") * 7).alias("size"), scalars.human_duration(F.col("id") * 7).alias("took"))


@query("SELECT doc_id, CASE WHEN h <> '' THEN h ELSE 'doc-' || doc_id END AS title FROM (SELECT doc_id, regexp_replace(regexp_extract(coalesce(text, ''), '(?m)^#+[ \\t]+([^\\r\\n]+)$', 1), '^\\s+|\\s+$', '', 'g') AS h FROM documents WHERE lower(trim(source)) IN ('note', 'runbook', 'release') AND NOT contains(coalesce(text, ''), chr(13)))")
def sf31_titles(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").filter(F.lower(F.trim("source")).isin("note", "runbook", "release") & ~F.coalesce("text", F.lit("")).contains("\r"))
    path = F.concat(F.lit("notes/doc-"), F.col("doc_id").cast("string"), F.lit(".md"))
    return rows.select("doc_id", scalars.markdown_title(F.coalesce("text", F.lit("")), path).alias("title"))


@query("SELECT id, 'https://h.example/' || repo || '/commit/' || external_id AS commit_url, 'https://h.example/' || repo || '/blob/' || content_hash || '/' || kind || '.py' AS blob_url, 'https://h.example/' || repo || '/discussions/new?category=ideas&title=' || replace(replace(replace(url_encode(external_id), '%20', '+'), '~', '%7E'), '%2A', '*') || '&body=' || replace(url_encode(repo), '%20', '+') AS discussion_url FROM artifact")
def sf32_urls(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "artifact")
    return rows.select(
        "id",
        scalars.commit_url("h.example", F.col("repo"), F.col("external_id")).alias("commit_url"),
        scalars.blob_url("h.example", F.col("repo"), F.col("content_hash"), F.concat("kind", F.lit(".py"))).alias("blob_url"),
        scalars.discussion_url("h.example", F.col("repo"), F.lit("ideas"), F.col("external_id"), F.col("repo")).alias("discussion_url"),
    )


@query("SELECT id, 'profile|lang=' || coalesce(language, '') || '|repo=' || coalesce(repo, '') || '|target=' || coalesce(CAST(target_id AS VARCHAR), '') AS cache_key FROM artifact")
def sf34_profile_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "artifact").select("id", scalars.profile_key(F.lit("profile"), F.col("language"), F.col("repo"), F.col("target_id")).alias("cache_key"))


@query("SELECT word, array_to_string(list_sort(list(other)), ' ') AS alternates FROM (SELECT DISTINCT w.word, o.word AS other FROM (SELECT unnest(string_split(g, ' ')) AS word, no FROM (" + " UNION ALL ".join(f"SELECT '{' '.join(g)}' AS g, {k} AS no" for k, g in enumerate(expand.SYNONYMS)) + ")) w JOIN (SELECT unnest(string_split(g, ' ')) AS word, no FROM (" + " UNION ALL ".join(f"SELECT '{' '.join(g)}' AS g, {k} AS no" for k, g in enumerate(expand.SYNONYMS)) + ")) o ON o.no = w.no AND o.word <> w.word WHERE w.no = (SELECT min(no) FROM (" + " UNION ALL ".join(f"SELECT '{' '.join(g)}' AS g, {k} AS no" for k, g in enumerate(expand.SYNONYMS)) + ") x WHERE list_contains(string_split(x.g, ' '), w.word))) GROUP BY word")
def sf9_synonyms(spark: SparkSession, d: str) -> DataFrame:
    """Alternates of every word of the table; a word in several groups has those of the first."""
    words = dict.fromkeys(w for g in expand.SYNONYMS for w in g)
    return spark.createDataFrame([(w, " ".join(expand.alternates(w))) for w in words], "word string, alternates string")


_PARTS = "list_sort(list_distinct(list_filter(string_split(regexp_replace(lower(regexp_replace(regexp_replace({0}, '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[_-]+', '_', 'g'), '_'), lambda p: p <> '' AND p <> lower({0}))))"


@query(f"SELECT id, array_to_string({_PARTS.format('symbol_name')}, ' ') AS parts FROM chunk WHERE symbol_name IS NOT NULL")
def sf10_symbol_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts of names, which follow a word's synonyms among its alternates."""
    rows = table(spark, d, "chunk").filter("symbol_name is not null")
    return rows.select("id", F.array_join(scalars.compound_parts(F.col("symbol_name")), " ").alias("parts"))


@query("SELECT id, n, 'src/f' || (id + n - 1) || '.py' AS path, 'diff --git a/x b/src/f' || (id + n - 1) || '.py' || chr(10) || '+line ' || n || chr(10) AS text FROM artifact, (VALUES (1), (2)) x(n)")
def ch3_file_sections(spark: SparkSession, d: str) -> DataFrame:
    part = lambda n: F.concat(F.lit("diff --git a/x b/src/f"), (F.col("id") + n - 1).cast("string"), F.lit(f".py\n+line {n}\n"))
    diffs = table(spark, d, "artifact").select("id", F.concat(F.lit("a line before\n"), part(1), part(2)).alias("diff"))

    def rows(key, diff):
        for n, (path, text) in enumerate(chunkers.file_sections(diff), 1):
            yield key, n, path, text

    return chunkers.per_row(diffs.select(F.col("id").cast("long"), "diff"), rows, "id long, n int, path string, text string")


# State


@query("SELECT kind, name, CASE WHEN id <= 4 THEN id END AS known_id, CASE WHEN id % 2 = 0 THEN external_id + 1 ELSE external_id END AS external_id FROM target_scope WHERE id <= 4 OR id % 2 = 0")
def up1_targets(spark: SparkSession, d: str) -> DataFrame:
    all_ = table(spark, d, "target_scope").select("id", "kind", "name", "external_id", "emails_json")
    new = all_.filter("id % 2 = 0").select("kind", "name", (F.col("external_id") + 1).alias("external_id"), "emails_json")
    return state.upsert_targets(all_.filter("id <= 4"), new).select("kind", "name", F.when(F.col("id") <= 4, F.col("id")).alias("known_id"), "external_id")


@query("SELECT email, CASE WHEN length(email) % 2 = 0 THEN 'x' || length(email) ELSE login END AS login FROM email_login_map UNION ALL SELECT 'new@x.example', NULL")
def up6_email_logins(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "email_login_map")
    new = old.filter(F.length("email") % 2 == 0).select(F.upper("email").alias("email"), F.concat(F.lit("x"), F.length("email")).alias("login"), "resolved_at", F.lit("again").alias("source"))
    missed = spark.createDataFrame([("NEW@x.example", None, None, "miss")], "email string, login string, resolved_at string, source string")
    return state.upsert_email_logins(old, new.unionByName(missed)).select("email", "login")


_CURSORS = "o AS (SELECT target_id, 'files' AS resource, max(last_files_at) AS cursor FROM repo GROUP BY target_id)"


@query(f"WITH {_CURSORS}, n AS (SELECT target_id, 'files' AS resource, max(last_commits_at) AS cursor FROM repo GROUP BY target_id UNION ALL SELECT 0, 'search', max(pushed_at) FROM repo) SELECT coalesce(n.target_id, o.target_id) AS target_id, coalesce(n.resource, o.resource) AS resource, coalesce(n.cursor, o.cursor) AS cursor FROM o FULL JOIN n ON n.target_id = o.target_id AND n.resource = o.resource")
def st1_sync_cursors(spark: SparkSession, d: str) -> DataFrame:
    repos = table(spark, d, "repo")
    of = lambda column: repos.groupBy("target_id").agg(F.max(column).alias("cursor")).select("target_id", F.lit("files").alias("resource"), "cursor")
    every = repos.agg(F.max("pushed_at").alias("cursor")).select(F.lit(0).alias("target_id"), F.lit("search").alias("resource"), "cursor")
    return state.set_sync_cursors(of("last_files_at"), of("last_commits_at").unionByName(every))


@query(f"WITH {_CURSORS} SELECT target_id, resource, greatest(cursor, '{_STARTED}') AS cursor FROM o UNION ALL SELECT 0, 'search', '2020-01-01T00:00:00Z'")
def st4_walk_cursors(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "repo").groupBy("target_id").agg(F.max("last_files_at").alias("cursor")).select("target_id", F.lit("files").alias("resource"), "cursor")
    other = spark.createDataFrame([(0, "search", "2020-01-01T00:00:00Z")], "target_id int, resource string, cursor string")
    return sync.walk_cursor(files.unionByName(other), "files", _STARTED)


@query("SELECT target_id, kind, external_id, decision FROM artifact WHERE external_id IS NOT NULL AND kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY target_id, kind, external_id ORDER BY id DESC) = 1")
def st7_stream_upserts(spark: SparkSession, d: str) -> DataFrame:
    """All artifacts as a stream of files, upserted into a table by key."""
    rows = durable(table(spark, d, "artifact").filter("external_id is not null and kind is not null").select("id", "target_id", "kind", "external_id", "decision"), "arriving")
    stream = spark.readStream.schema(rows.schema).parquet(rows.inputFiles()[0].rsplit("/", 1)[0])
    path = _landing(spark, "synced")
    sync.sync_table(spark, stream, path, ["target_id", "kind", "external_id"], f"{path}-mark", seq="id", buckets=4).awaitTermination()
    return sync.synced(spark, path, 4).select("target_id", "kind", "external_id", "decision")


_NOTES = "w AS (SELECT n.id, n.path, md5(n.text) AS hash FROM (SELECT c.id, CASE WHEN json_valid(c.context_json) THEN json_extract_string(c.context_json, '$.path') END AS path, c.text FROM chunk c WHERE c.kind = 'note' AND c.text IS NOT NULL) n WHERE path IS NOT NULL), h AS (SELECT path, min(id) AS id, min(hash) AS hash FROM w WHERE id % 3 <> 0 GROUP BY 1), k AS (SELECT path, max(hash) AS hash FROM w WHERE id % 3 <> 1 GROUP BY 1)"


@query(f"WITH {_NOTES} SELECT k.path, k.hash, h.id AS known_id FROM k LEFT JOIN h ON h.path = k.path")
def up12_synced_notes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunk").filter("kind = 'note' and text is not null").select("id", F.get_json_object("context_json", "$.path").alias("path"), F.md5("text").alias("hash")).filter("path is not null")
    held = rows.filter("id % 3 <> 0").groupBy("path").agg(F.min("id").alias("id"), F.min("hash").alias("hash"))
    disk = rows.filter("id % 3 <> 1").groupBy("path").agg(F.max("hash").alias("hash")).withColumn("text", F.col("hash"))
    notes, _ = state.sync_notes(held.select("id", "path", "hash", F.col("hash").alias("text")), disk)
    return notes.join(held.select("path", F.col("id").alias("_id")), "path", "left").select("path", "hash", F.when(F.col("_id") == F.col("id"), F.col("id")).alias("known_id"))


@query("SELECT repo, count(*) AS n FROM artifact GROUP BY repo")
def up13_versions(spark: SparkSession, d: str) -> DataFrame:
    """A table that is written twice; readers see the last version."""
    path, artifacts = _landing(spark, "versions"), table(spark, d, "artifact")
    state.switch(spark, artifacts.groupBy("repo").agg(F.lit(0).cast("long").alias("n")), path)
    state.switch(spark, artifacts.groupBy("repo").agg(F.count("*").alias("n")), path)
    return state.read_current(spark, path)


@query("SELECT target_id, full_name, CAST(NULL AS VARCHAR) AS head_sha, CAST(NULL AS BIGINT) AS size_kb FROM repo")
def up14_migrated(spark: SparkSession, d: str) -> DataFrame:
    repos = table(spark, d, "repo")
    return state.migrate(repos.select("target_id", "full_name"), repos.select("target_id", "full_name", "head_sha", "size_kb"))


@query("SELECT id, length(text) || ' characters' AS summary FROM chunk WHERE text IS NOT NULL AND text <> ''")
def ud6_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Summaries by a model; where it fails none is written."""

    def say(text: str) -> str:
        if not text:
            raise ValueError("nothing to say")
        return f" {len(text)} characters\n"

    return embed.summarize(table(spark, d, "chunk"), say)


@query("SELECT 'files/' || regexp_replace(regexp_replace(replace(lower(a.repo), '/', '__'), '[^a-z0-9_]+', '-', 'g'), '^[-_]+|[-_]+$', '', 'g') || '/' || p || '.md' AS path, count(*) AS n_chunks FROM (SELECT c.*, CASE WHEN json_valid(context_json) THEN json_extract_string(context_json, '$.path') END AS p FROM chunk c WHERE kind = 'file') c JOIN artifact a ON a.id = c.artifact_id WHERE p IS NOT NULL AND a.repo IS NOT NULL GROUP BY a.repo, p")
def wn7_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of files with a bullet for each chunk, counted."""
    pages = vault.file_pages(table(spark, d, "chunk"), table(spark, d, "artifact"))
    body = F.regexp_replace("text", r"(?s)^---.*?---\s+# [^\n]*", "")
    return pages.select("path", F.size(F.regexp_extract_all(body, F.lit(r"(?m)^- (?:\(lines\)|\w)"), F.lit(0))).cast("long").alias("n_chunks"))


# Evaluation and reports


@query("WITH p AS (SELECT round(1 + embedding[1], 6)::DOUBLE AS b, round(1 + embedding[2], 6)::DOUBLE AS i FROM embeddings) SELECT count(*) AS n, round(avg(b), 4) AS mean_baseline, round(avg(i), 4) AS mean_informed, round(avg(b - i), 4) AS delta, round(avg(b - i) / (stddev_samp(b - i) / sqrt(count(*))), 3) AS t FROM p")
def ev4_review_report(spark: SparkSession, d: str) -> DataFrame:
    at = lambda k: F.round(1 + F.col("embedding")[k].cast("double"), 6)
    made = evaluate.review_report(table(spark, d, "embeddings").select(at(0).alias("baseline"), at(1).alias("informed")))
    return made.select("n", *(F.round(c, 4).alias(c) for c in ("mean_baseline", "mean_informed", "delta")), F.round("t", 3).alias("t"))


_CONSOLE = "r AS (SELECT coalesce(kind, '-') AS kind, CAST(count(*) AS VARCHAR) AS n, row_number() OVER (ORDER BY kind) AS no FROM artifact GROUP BY kind), w AS (SELECT CAST(greatest(max(length(kind)), 4) AS INT) AS wk, CAST(greatest(max(length(n)), 1) AS INT) AS wn FROM r)"


@query(f"WITH {_CONSOLE} SELECT 1 AS line_no, rtrim(rpad('kind', wk, ' ') || '  ' || lpad('n', wn, ' ')) AS line FROM w UNION ALL SELECT 2, repeat('-', wk) || '  ' || repeat('-', wn) FROM w UNION ALL SELECT no + 2, rtrim(rpad(kind, wk, ' ') || '  ' || lpad(n, wn, ' ')) FROM r, w")
def sk2_console_table(spark: SparkSession, d: str) -> DataFrame:
    return report.console_table(table(spark, d, "artifact").groupBy("kind").agg(F.count("*").alias("n")), F.col("kind"))


@query("SELECT repo AS trace, count(*) AS n_spans, 'walker' AS service, min(kind) AS least_name FROM artifact WHERE repo IS NOT NULL AND kind IS NOT NULL GROUP BY repo")
def sk3_spans(spark: SparkSession, d: str) -> DataFrame:
    """A trace for each repository, a span for each of its artifacts; read back from its JSON."""
    began = F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 1000)
    steps = table(spark, d, "artifact").filter("repo is not null and kind is not null").select(F.col("repo").alias("trace"), F.col("id").cast("string").alias("step"), F.lit(None).cast("string").alias("parent"), F.col("kind").alias("name"), began.alias("began"), (began + F.expr("INTERVAL 1 SECOND")).alias("ended"), F.create_map(F.lit("kind"), F.col("kind")).alias("attributes"))
    lines = report.spans(steps, "walker")
    schema = "struct<resourceSpans:array<struct<resource:struct<attributes:array<struct<key:string,value:struct<stringValue:string>>>>,scopeSpans:array<struct<spans:array<struct<name:string,spanId:string>>>>>>>"
    read = lines.select("trace", F.from_json("line", schema)["resourceSpans"][0].alias("r"))
    spans = F.col("r.scopeSpans")[0]["spans"]
    return read.select("trace", F.size(F.array_distinct(spans["spanId"])).cast("long").alias("n_spans"), F.col("r.resource.attributes")[0]["value"]["stringValue"].alias("service"), F.array_min(spans["name"]).alias("least_name"))
