"""What users ask: review comments, examples of style, code, rules, and the outcome of a review.

Each takes a set of queries at once (query_id, query, embedding) and gives ranked rows for each. A
blank query has no rows."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions.expand import QueryExpander
from corvane.functions.scalars import is_blank, truncated
from corvane.operators import fusion, text_index, vector
from corvane.operators.filters import Filters, candidate_ids, matches_glob
from corvane.runtime import durable, unsent
from corvane.schema import DECISIONS, FETCH, OVER_GLOB, TOP, TOP_VOTE


class NotReady(RuntimeError):
    """There is nothing to search yet; the message says what to do."""


@dataclass
class Corpus:
    """Tables that searches read. ``vectors``: chunk_id, embedding. What searches need again and again
    is made anew each time, or stored once (see stored): ``posts`` the keyword index, ``lengths`` of
    texts, ``copies`` the keys by which copies are known, ``texts`` their number."""

    targets: DataFrame
    artifacts: DataFrame
    chunks: DataFrame
    vectors: DataFrame
    posts: DataFrame | None = None
    ascii_only: bool = False
    stem: bool = False
    lengths: DataFrame | None = None
    copies: DataFrame | None = None
    texts: DataFrame | None = None

    def postings(self) -> DataFrame:
        return self.posts if self.posts is not None else text_index.postings(self.chunks, "id", "text", self.stem, self.ascii_only)

    def sizes(self) -> DataFrame:
        return self.lengths if self.lengths is not None else text_index.sizes_of(self.chunks, "id", "text", self.ascii_only)

    def n_texts(self) -> DataFrame:
        return self.texts if self.texts is not None else self.chunks.filter("text is not null").agg(F.count("*"))

    def keys(self) -> DataFrame:
        return self.copies if self.copies is not None else fusion.hit_keys(self.chunks, self.artifacts)

    def stored(self) -> Corpus:
        """The same with its index written: the keyword index, lengths, keys, and the vectors with the
        key and all that filters ask for beside them, so that a search joins and moves no vectors."""
        posts = durable(text_index.index(text_index.postings(self.chunks, "id", "text", self.stem, self.ascii_only)), "index", True)
        lengths = durable(text_index.sizes_of(self.chunks, "id", "text", self.ascii_only), "lengths", True)
        copies = durable(fusion.hit_keys(self.chunks, self.artifacts), "copies", True)
        chunks = self.chunks.select(F.col("id").alias("chunk_id"), "artifact_id", "kind", "language", "node_kind")
        made_by = self.artifacts.select(F.col("id").alias("artifact_id"), "repo", "author_login", "target_id")
        facts = chunks.join(unsent(made_by), "artifact_id", "left").join(unsent(copies.select("chunk_id", "object")), "chunk_id", "left").drop("artifact_id")
        vectors = durable(self.vectors.select("chunk_id", "embedding").join(unsent(facts.withColumn("known", F.lit(True))), "chunk_id", "left"), "vectors", True)
        return replace(self, vectors=vectors, posts=posts, lengths=lengths, copies=copies, texts=durable(self.n_texts().toDF("n"), "texts", True))


def require_data(corpus: Corpus) -> None:
    """End with NotReady where nothing was ingested, or nothing embedded."""
    if corpus.chunks.isEmpty():
        raise NotReady("nothing is ingested yet: ingest a scope first")
    if corpus.vectors.isEmpty():
        raise NotReady("nothing is embedded yet: embed the pending chunks first")


def vector_search(corpus: Corpus, queries: DataFrame, filters: Filters, k: int = TOP, coalesce: bool = True, mode: str = "filter_first") -> DataFrame:
    """Nearest chunks of each query among those that pass the filters, copies made one. ``mode``
    filter_first is exact; filter_last takes the nearest of all first and keeps copies."""
    if mode not in ("filter_first", "filter_last"):
        raise ValueError(f"unknown mode: {mode}")
    stored, condition = "object" in corpus.vectors.columns, filters.on_chunk()
    if mode == "filter_last":
        candidates = candidate_ids(corpus.chunks, corpus.artifacts, filters)
        return vector.knn_then_filter(corpus.vectors.select("chunk_id", "embedding"), candidates, queries, k)
    if stored:
        of_artifact = filters.on_artifact()
        vectors = corpus.vectors.filter("known").filter(condition if of_artifact is None else condition & of_artifact)
    else:
        vectors = corpus.vectors.join(candidate_ids(corpus.chunks, corpus.artifacts, filters), "chunk_id", "left_semi")
    if not coalesce:
        return vector.knn(vectors.select("chunk_id", "embedding"), queries, k)
    keyed = vectors.filter("object is not null") if stored else vectors.join(corpus.keys(), "chunk_id")
    return vector.knn(keyed.select("chunk_id", "embedding", "object"), queries, k)


class VectorStore(Protocol):
    """Where vectors are searched: hits are query_id, chunk_id, distance and rank."""

    def search(self, corpus: Corpus, queries: DataFrame, filters: Filters, k: int) -> DataFrame: ...


class FilterFirst:
    """Exact: filters, then the nearest, copies made one."""

    def search(self, corpus: Corpus, queries: DataFrame, filters: Filters, k: int = TOP) -> DataFrame:
        return vector_search(corpus, queries, filters, k)


class FilterLast:
    """The nearest of all, then filters; copies stay, and there may be fewer than k."""

    def search(self, corpus: Corpus, queries: DataFrame, filters: Filters, k: int = TOP) -> DataFrame:
        return vector_search(corpus, queries, filters, k, mode="filter_last")


def vector_store(name: str) -> VectorStore:
    """The store of a name: ``exact`` or ``overfetch``."""
    stores = {"exact": FilterFirst, "overfetch": FilterLast}
    if name not in stores:
        raise ValueError(f"unknown store {name}: one of {sorted(stores)}")
    return stores[name]()


def keyword_search(corpus: Corpus, queries: DataFrame, filters: Filters, k: int | None = TOP, coalesce: bool = True, expander: QueryExpander | None = None) -> DataFrame:
    """Best chunks of each query by BM25 among those that pass the filters, copies made one."""
    groups = text_index.expanded_queries(queries, expander) if expander else text_index.plain_queries(queries)
    phrases = text_index.phrases_of(groups, corpus.stem, corpus.ascii_only)
    candidates = candidate_ids(corpus.chunks, corpus.artifacts, filters)
    return text_index.bm25(corpus.postings(), phrases, candidates, k, corpus.n_texts(), corpus.sizes(), corpus.keys() if coalesce else None)


def hybrid_search(corpus: Corpus, queries: DataFrame, filters: Filters, k: int | None = TOP, fetch: int = FETCH, half_life_days: float | None = None, now: str | None = None, expander: QueryExpander | None = None) -> DataFrame:
    """Both searches fused, ``fetch`` hits of each."""
    # Both searches read the queries; written once, their source isn't read and planned again in each place.
    asked = durable(queries.filter(~is_blank(F.col("query"))), "queries")
    near = vector_search(corpus, asked, filters, fetch)
    words = keyword_search(corpus, asked, filters, fetch, expander=expander)
    return fusion.fuse(near, words, corpus.keys(), k, half_life_days, now)


def all_modes(corpus: Corpus, queries: DataFrame, filters: Filters, k: int = TOP, fetch: int = FETCH, half_life_days: float | None = None, now: str | None = None) -> dict[str, DataFrame]:
    """Hits of the modes vector, bm25 and hybrid. Each search runs once and is kept for the fused mode,
    in which alone the half-life counts and blank queries have no hits."""
    near = durable(vector_search(corpus, queries, filters, max(fetch, k)), "near")
    words = durable(keyword_search(corpus, queries, filters, max(fetch, k)), "words")
    asked = queries.filter(~is_blank(F.col("query"))).select("query_id")
    legs = [leg.filter(F.col("rank") <= fetch).join(asked, "query_id", "left_semi") for leg in (near, words)]
    fused = fusion.fuse(*legs, corpus.keys(), k, half_life_days, now)
    return {"vector": near.filter(F.col("rank") <= k), "bm25": words.filter(F.col("rank") <= k), "hybrid": fused}


def _context(key: str) -> Column:
    return F.get_json_object("context_json", f"$.{key}")


def _found(corpus: Corpus, queries: DataFrame, filters: Filters, k: int | None, **options) -> DataFrame:
    # Written, hits are known to be few before texts are joined, and the driver plans search and texts apart.
    hits = durable(hybrid_search(corpus, queries, filters, k, **options), "fused")
    return fusion.hit_rows(hits, corpus.chunks, corpus.artifacts, corpus.targets)


def find_review_comments(corpus: Corpus, queries: DataFrame, filters: Filters = Filters(), k: int = TOP, **options) -> DataFrame:
    """Comments of earlier reviews that fit a hunk or a question."""
    rows = _found(corpus, queries, replace(filters, kind="review_comment"), k, **options)
    return rows.select("query_id", "rank", F.col("text").alias("comment"), truncated(_context("diff_hunk")).alias("diff_hunk_context"), _context("path").alias("path"), F.col("artifact_language").alias("language"), _context("pr_title").alias("pr_title"), F.col("artifact_repo").alias("repo"), F.col("target_name").alias("target"), F.col("source_url").alias("url"), F.round("distance", 4).alias("distance"))


def find_style_examples(corpus: Corpus, queries: DataFrame, filters: Filters = Filters(), k: int = TOP, **options) -> DataFrame:
    """Code that was committed."""
    rows = _found(corpus, queries, replace(filters, kind="code"), k, **options)
    return rows.select("query_id", "rank", truncated(F.col("text")).alias("code_snippet"), F.col("artifact_language").alias("language"), _context("path").alias("path"), F.col("artifact_repo").alias("repo"), F.col("target_name").alias("target"), F.col("source_url").alias("commit_url"), F.round("distance", 4).alias("distance"))


def find_code(corpus: Corpus, queries: DataFrame, filters: Filters = Filters(), k: int = TOP, path_glob: str | None = None, **options) -> DataFrame:
    """Files at head; with a glob more hits are fetched and those that match it stay."""
    rows = _found(corpus, queries, replace(filters, kind="file"), k * OVER_GLOB if path_glob else k, **options)
    if path_glob:
        rows = rows.filter(F.coalesce(matches_glob(_context("path"), path_glob), F.lit(False)))
        rows = rows.withColumn("_no", F.row_number().over(W.partitionBy("query_id").orderBy("rank"))).filter(F.col("_no") <= k).drop("rank").withColumnRenamed("_no", "rank")
    return rows.select("query_id", "rank", truncated(F.col("text")).alias("code_snippet"), F.col("artifact_language").alias("language"), _context("path").alias("path"), _context("start_line").cast("int").alias("start_line"), _context("end_line").cast("int").alias("end_line"), "node_kind", "symbol_name", F.col("artifact_repo").alias("repo"), F.col("target_name").alias("target"), F.col("source_url").alias("url"), F.round("distance", 4).alias("distance"))


def find_applicable_rules(corpus: Corpus, queries: DataFrame, filters: Filters = Filters(), k: int = TOP, **options) -> DataFrame:
    """Rules for code that fit."""
    rows = _found(corpus, queries, replace(filters, kind="code_rule"), k, **options)
    return rows.select("query_id", "rank", F.col("text").alias("rule"), _context("language").alias("language"), _context("examples").alias("examples"), F.col("target_name").alias("target"), F.round("distance", 4).alias("distance"))


def reviewer_decision(meta: Column, login: str) -> Column:
    """The last decision of a reviewer in the metadata of a pull request, in lower case; dismissed
    and pending reviews and other words are none."""
    schema = "struct<reviewer_decisions:array<struct<login:string,state:string,submitted_at:string>>>"
    reviews = F.filter(F.from_json(meta, schema)["reviewer_decisions"], lambda r: r["login"] == F.lit(login))
    last = F.element_at(F.array_sort(F.transform(reviews, lambda r: F.struct(F.coalesce(r["submitted_at"], F.lit("")).alias("t"), r["state"].alias("s")))), -1)
    state = F.lower(F.when(F.size(reviews) > 0, last["s"]))
    return F.when(state.isin(*DECISIONS), state)


def votes(hits: DataFrame, decision: str = "decision") -> DataFrame:
    """query_id, prediction, confidence, one weight per decision, n_pulled and n_with_decision: each
    hit votes with 1 / (1 + distance); ties go by the order of decisions; no vote is ``unknown``."""
    weight = 1.0 / (1.0 + F.greatest(F.col("distance"), F.lit(0.0)))
    sums = [F.coalesce(F.sum(F.when(F.col(decision) == d, weight)), F.lit(0.0)).alias(d) for d in DECISIONS]
    rows = hits.groupBy("query_id").agg(*sums, F.count("*").alias("n_pulled"), F.count_if(F.col(decision).isin(*DECISIONS)).alias("n_with_decision"))
    total = F.round(F.col(DECISIONS[0]) + F.col(DECISIONS[1]) + F.col(DECISIONS[2]), 12)
    top = F.greatest(*(F.round(d, 12) for d in DECISIONS))
    best = F.coalesce(*(F.when((F.round(d, 12) == top) & (top > 0), F.lit(d)) for d in DECISIONS), F.lit("unknown"))
    return rows.select("query_id", best.alias("prediction"), F.when(total > 0, F.round(top / total, 4)).otherwise(0.0).alias("confidence"), *(F.round(d, 4).alias(f"weight_{d}") for d in DECISIONS), "n_pulled", "n_with_decision")


def predict_review_outcome(corpus: Corpus, queries: DataFrame, filters: Filters = Filters(), k: int = TOP_VOTE, reviewer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(votes, support): what the nearest pull requests were decided. ``reviewer`` asks for that
    reviewer's decision of each, and filters nothing."""
    hits = vector_search(corpus, queries, replace(filters, kind="pr_summary", author=None), k)
    rows = fusion.hit_rows(hits, corpus.chunks, corpus.artifacts, corpus.targets)
    if reviewer is not None:
        rows = rows.withColumn("decision", reviewer_decision(F.col("meta_json"), reviewer))
    support = rows.select("query_id", "rank", F.col("source_url").alias("url"), F.get_json_object("meta_json", "$.title").alias("title"), F.col("artifact_repo").alias("repo"), F.col("target_name").alias("target"), F.round("distance", 4).alias("distance"), "decision")
    empty = queries.select("query_id").join(rows.select("query_id").distinct(), "query_id", "left_anti")
    none = empty.select("query_id", F.lit("unknown").alias("prediction"), F.lit(0.0).alias("confidence"), *(F.lit(0.0).alias(f"weight_{d}") for d in DECISIONS), F.lit(0).cast("long").alias("n_pulled"), F.lit(0).cast("long").alias("n_with_decision"))
    return votes(rows).unionByName(none), support


def resolve_scope(targets: DataFrame, scope: str | None, repo: str | None = None, target_id: int | None = None) -> Filters:
    """The filters that a scope stands for: ``personal`` is the user's own target, ``project`` the
    repository's; what is given explicitly wins. Targets are a table of few rows."""
    if target_id is not None or scope is None:
        return Filters(repo=repo, target_id=target_id)
    if scope == "personal":
        row = targets.filter("kind = 'user'").orderBy("id").select("id").first()
        return Filters(repo=repo, target_id=row[0] if row else None)
    if scope == "project":
        row = targets.filter((F.col("kind") == "repo") & (F.col("name") == F.lit(repo))).orderBy("id").select("id").first()
        return Filters(repo=repo, target_id=row[0] if row else None)
    raise ValueError(f"unknown scope: {scope}")
