import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions.expand import RuleExpander, match_plain
from corvane.operators import fusion, text_index, tools, vector
from corvane.operators.filters import Filters
from corvane.plans import queries

TEXTS = ["alpha beta beta gamma", "alpha.beta user_id testing", "café tests beta", "", None, "user id beta alpha", "beta", "tested café user_id delta " * 40]


def _texts(spark):
    return spark.createDataFrame([(k, t, "clash") for k, t in enumerate(TEXTS)], "id long, text string, term string")


@pytest.mark.parametrize("query", ["beta", "alpha.beta", "test", "café user_id", ":: beta", "cafe", "missing beta", "beta beta"])
def test_keyword_scores_are_those_of_fts5(spark, query):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(text, tokenize=\"porter unicode61 remove_diacritics 2 tokenchars '_'\")")
    con.executemany("insert into f(rowid, text) values (?, ?)", [(k, t) for k, t in enumerate(TEXTS) if t is not None])
    want = {r: s for r, s in con.execute("select rowid, bm25(f) from f where f match ?", (match_plain(query),))}
    posts = text_index.postings(_texts(spark), "id", "text", stem=True)
    asked = spark.createDataFrame([(1, query)], "query_id long, query string")
    n = _texts(spark).filter("text is not null").agg(F.count("*"))
    phrases = text_index.phrases_of(text_index.plain_queries(asked), stem=True)
    got = {r.chunk_id: r.score for r in text_index.bm25(posts, phrases, k=None, n_texts=n).collect()}
    assert got == pytest.approx(want, rel=1e-6)


def test_keyword_search_of_nothing(spark):
    posts = text_index.postings(_texts(spark).limit(0), "id", "text")
    asked = spark.createDataFrame([(1, "beta"), (2, None), (3, "::")], "query_id long, query string")
    assert text_index.bm25(posts, text_index.phrases_of(text_index.plain_queries(asked))).count() == 0
    groups = text_index.expanded_queries(asked, RuleExpander()).collect()
    assert {r.query_id: r.groups for r in groups} == {1: [["beta"]], 2: [], 3: []}


def _vectors(spark, n=300, dim=8):
    x = np.random.default_rng(1).normal(size=(n, dim)).round(3)
    x[7] = x[5]  # a tie
    rows = [(k, [float(v) for v in r], "extra") for k, r in enumerate(x)] + [(n, None, "extra")]
    return x, spark.createDataFrame(rows, "chunk_id long, embedding array<float>, distance string")


def test_nearest_are_those_of_brute_force(spark):
    x, vectors = _vectors(spark)
    queries = vectors.filter("chunk_id < 40").select(F.col("chunk_id").alias("query_id"), "embedding")
    for block in (7, 1000):
        got = vector.knn(vectors, queries, 5, block).collect()
        for q in range(40):
            d = np.sqrt(((x.astype(np.float32).astype(float) - x[q].astype(np.float32).astype(float)) ** 2).sum(1)).round(9)
            want = sorted(range(len(x)), key=lambda k: (d[k], k))[:5]
            assert [r.chunk_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want


def test_nearest_of_nothing_and_of_wrong_length(spark):
    _, vectors = _vectors(spark, 10)
    queries = vectors.limit(2).select(F.col("chunk_id").alias("query_id"), "embedding")
    assert vector.knn(vectors.limit(0), queries).count() == 0 and vector.knn(vectors, queries.limit(0)).count() == 0
    short = spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<float>")
    with pytest.raises(Exception, match="numbers"):
        vector.knn(vectors, short).collect()
    with pytest.raises(Exception, match="numbers"):
        vector.checked(vectors, 5).select("embedding").collect()


def _corpus(spark):
    targets = spark.createDataFrame([(1, "user", "me"), (2, "org", "us")], "id int, kind string, name string")
    artifacts = spark.createDataFrame(
        [(1, 1, "commit", "a", "r/x", "python", "u1", "2024-05-16T00:00:00Z", None, None), (2, 2, "commit", "a", "r/x", "python", "u1", "2024-05-16T00:00:00Z", None, None), (3, 1, "commit", "b", "r/y", "go", None, "2026-05-15T00:00:00Z", "approved", '{"title":"T"}'), (4, 2, "commit", "c", None, None, "u2", "bad", None, "{cut")],
        "id long, target_id int, kind string, external_id string, repo string, language string, author_login string, created_at string, decision string, meta_json string",
    ).withColumn("source_url", F.lit("u"))
    chunks = spark.createDataFrame(
        [(10, 1, "code", "needle shared", None, "python", None, None), (20, 2, "code", "needle shared", "{cut", "python", None, None), (30, 3, "code", "shared other", '{"path":"a/b.py"}', "go", "function_definition", "f"), (40, 4, "code", None, None, None, None, None), (50, 99, "code", "needle", None, None, None, None)],
        "id long, artifact_id long, kind string, text string, context_json string, language string, node_kind string, symbol_name string",
    )
    vectors = spark.createDataFrame([(10, [1.0, 0.0]), (20, [1.0, 0.0]), (30, [0.0, 1.0]), (40, [0.5, 0.5])], "chunk_id long, embedding array<float>")
    return tools.Corpus(targets, artifacts, chunks, vectors, ascii_only=True)


def test_copies_under_several_targets_are_one_hit(spark):
    corpus = _corpus(spark)
    asked = spark.createDataFrame([(1, "needle", [1.0, 0.0])], "query_id long, query string, embedding array<float>")
    near = tools.vector_search(corpus, asked, Filters(kind="code"), 3).orderBy("rank").collect()
    assert [r.chunk_id for r in near] == [10, 40, 30]
    assert [r.chunk_id for r in tools.vector_search(corpus, asked, Filters(kind="code"), 3, coalesce=False).orderBy("rank").collect()] == [10, 20, 40]
    assert [r.chunk_id for r in tools.keyword_search(corpus, asked, Filters(kind="code")).collect()] == [10]
    assert [r.chunk_id for r in tools.vector_search(corpus, asked, Filters(kind="code", repo="r/y")).collect()] == [30]


def test_fusion_and_decay(spark):
    corpus = _corpus(spark)
    asked = spark.createDataFrame([(1, "needle", [1.0, 0.0]), (2, " ", [1.0, 0.0])], "query_id long, query string, embedding array<float>")
    hits = tools.hybrid_search(corpus, asked, Filters(kind="code")).orderBy("rank").collect()
    assert {r.query_id for r in hits} == {1}
    assert hits[0].chunk_id == 10 and abs(hits[0].distance - (1 - 2 / 61)) < 1e-12
    aged = {r.chunk_id: r.score for r in tools.hybrid_search(corpus, asked, Filters(kind="code"), half_life_days=365, now="2026-05-16T00:00:00Z").collect()}
    assert abs(aged[10] - 0.25 * 2 / 61) < 1e-9 and abs(aged[40] - 1 / 62) < 1e-12  # a bad date keeps its score
    rows = fusion.hit_rows(tools.hybrid_search(corpus, asked, Filters(kind="code")), corpus.chunks, corpus.artifacts, corpus.targets)
    assert rows.count() == 3 and len(set(rows.columns)) == len(rows.columns)


def test_votes_and_readiness(spark):
    hits = spark.createDataFrame([(1, 0.0, "commented"), (1, 1.0, "approved"), (1, 1.0, "approved"), (1, 3.0, None), (2, 0.0, None)], "query_id long, distance double, decision string")
    said = {r.query_id: r for r in tools.votes(hits).collect()}
    assert (said[1].prediction, said[1].confidence, said[1].n_pulled, said[1].n_with_decision) == ("approved", 0.5, 4, 3)
    assert (said[2].prediction, said[2].confidence) == ("unknown", 0.0)
    corpus = _corpus(spark)
    tools.require_data(corpus)
    with pytest.raises(tools.NotReady, match="embed"):
        tools.require_data(tools.Corpus(corpus.targets, corpus.artifacts, corpus.chunks, corpus.vectors.limit(0)))
    with pytest.raises(tools.NotReady, match="ingest"):
        tools.require_data(tools.Corpus(corpus.targets, corpus.artifacts, corpus.chunks.limit(0), corpus.vectors))
    assert tools.resolve_scope(corpus.targets, "personal").target_id == 1 and tools.resolve_scope(corpus.targets, "project", "r").target_id is None
    with pytest.raises(ValueError):
        tools.resolve_scope(corpus.targets, "other")


def test_reviewer_decision_takes_the_last(spark):
    meta = '{"reviewer_decisions":[{"login":"a","state":"APPROVED","submitted_at":"2"},{"login":"a","state":"COMMENTED","submitted_at":"1"},{"login":"b","state":"DISMISSED","submitted_at":"9"}]}'
    df = spark.createDataFrame([(meta,), (None,), ("{cut",)], "m string")
    assert [r[0] for r in df.select(tools.reviewer_decision(F.col("m"), "a")).collect()] == ["approved", None, None]
    assert df.select(tools.reviewer_decision(F.col("m"), "b")).first()[0] is None


def _sent(plan):
    """Scans of written tables that a plan broadcasts by key, row by row."""
    out, depth, rows = [], None, []
    for line in [*plan.split("\n"), ""]:
        at = len(line) - len(line.lstrip(" :+-*()0123456789"))
        if depth is not None and at <= depth:
            if not any("Aggregate" in r for r in rows):
                out += [name for r in rows for name in ("copies-", "hits-", "lengths-") if "FileScan" in r and name in r]
            depth, rows = None, []
        if depth is not None:
            rows.append(line)
        elif "BroadcastExchange HashedRelation" in line:
            depth = at
    return out


@pytest.mark.parametrize("name", ["rt7_hybrid", "rt12_find_code", "rt11_find_style_examples", "rt13_find_applicable_rules"])
def test_searches_broadcast_no_table_of_the_corpus(spark, data, name):
    # All of them are far below Spark's limit for broadcasts here, as their files are at a million rows.
    spark.conf.set("spark.sql.maxMetadataStringLength", "500")
    try:
        found = queries.queries()[name](spark, data)
        found.collect()
        assert _sent(found._jdf.queryExecution().executedPlan().toString()) == []
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")


@pytest.mark.parametrize("name, kind", [("rt12_find_code", "file"), ("rt11_find_style_examples", "code"), ("rt13_find_applicable_rules", "code_rule")])
def test_tools_read_the_query_set_once(spark, data, name, kind):
    # Else its source is read and planned at each place of the search, and the index is shuffled to meet its words.
    spark.conf.set("spark.sql.maxMetadataStringLength", "500")
    try:
        found = queries.queries()[name](spark, data)
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
        assert plan.count("/chunk.parquet") == 1 and "/embeddings.parquet" not in plan
        hits = tools.hybrid_search(queries._corpus(spark, data), queries._asked(spark, data), Filters(kind=kind))
        hits.collect()
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert "/embeddings.parquet" not in plan and _sent(plan) == []
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
