"""Queries of the ten problems over the tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import docpairs, generated, history, leaks, mix, pii, secrets, spans, split, tokens
from corvane.runtime import durable
from corvane.sources.tables import table

#: Begin of the held-out period; compared as text.
HELD_OUT = "2026-01-01"
CODE = ("code", "file")


def _pieces(spark: SparkSession, d: str, range_chars: int = split.RANGE_CHARS) -> DataFrame:
    limits = table(spark, d, "size_limit").select(F.col("kind").alias("_kind"), "max_chars", "overlap_chars")
    chunks = table(spark, d, "chunk", True).select("id", "kind", "text").join(limits, F.col("kind") == F.col("_kind"))
    return split.split_texts(chunks, "id", "text", F.col("max_chars"), F.col("overlap_chars"), F.col("kind").isin(*CODE), range_chars).withColumnRenamed("id", "chunk_id")


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d)


def p1_tiling(spark: SparkSession, d: str) -> DataFrame:
    """Small ranges, so that texts cross their edges; pieces must cover each text all the same."""
    limits = table(spark, d, "size_limit").select(F.col("kind").alias("_kind"), "max_chars")
    kinds = table(spark, d, "chunk").select(F.col("id").alias("chunk_id"), "kind")
    tiles = split.tiling(_pieces(spark, d, 1024), "chunk_id").join(kinds, "chunk_id").join(limits, F.col("kind") == F.col("_kind"))
    return tiles.select("chunk_id", "n_chars", "new_chars", (F.col("longest") <= F.col("max_chars")).alias("within"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return split.found(_pieces(spark, d), "chunk_id")


def _judged(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "artifact").filter("kind = 'file'").select("id", "source_url", "repo", "language")
    chunks = table(spark, d, "chunk", True).filter("kind = 'file'").select("artifact_id", "text", "context_json")
    return generated.judge(generated.features(files, chunks))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).filter("found").select(F.col("id").alias("artifact_id"))


def p2_handwritten(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).filter("not found").select(F.col("id").alias("artifact_id"), F.round("score", 4).alias("score"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "review_holdout").filter(F.col("created_at") >= HELD_OUT)
    return leaks.find_leaks(table(spark, d, "documents", True), "doc_id", "text", items, "item_id", ["truth_comment", "diff_hunk"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.exact(_leaks(spark, d))


def p3_regions(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d)


def _functions(spark: SparkSession, d: str, ends: bool = False) -> tuple[DataFrame, DataFrame]:
    chunks = table(spark, d, "chunk", True).filter(F.col("kind").isin(*CODE)).select("id", "text", "language", "node_kind", "context_json")
    return chunks, docpairs.documented(chunks, "id", "text", F.col("language"), F.col("node_kind"), F.get_json_object("context_json", "$.leading_doc"), ends=ends)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _functions(spark, d)[1].select(F.col("id").alias("chunk_id"), "symbol").distinct()


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    chunks, found = _functions(spark, d, True)
    return docpairs.pairs(chunks, "id", "text", found).withColumnRenamed("id", "chunk_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    chunks = secrets.scan(table(spark, d, "chunk", True), "id", "text").withColumn("place", F.lit("chunk.text"))
    urls = secrets.scan(table(spark, d, "artifact", True).filter("source_url is not null"), "id", "source_url").withColumns({"place": F.lit("artifact.source_url"), "line_no": F.lit(1).cast("long")})
    # All spans of a row come from one task, so lines are made distinct where they are.
    return chunks.unionByName(urls).filter("kind <> 'continued'").select("place", "row_id", "line_no").distinct()


def p5_masked(spark: SparkSession, d: str) -> DataFrame:
    chunks = secrets.redact(table(spark, d, "chunk", True), "id", "text").withColumn("place", F.lit("chunk.text"))
    urls = secrets.redact(table(spark, d, "artifact", True).filter("source_url is not null"), "id", "source_url").withColumn("place", F.lit("artifact.source_url"))
    return chunks.unionByName(urls).filter("n_found > 0").select("place", "row_id", "masked", "n_found")


KEYS = ("kind", "external_id", "content_hash")


def _history(spark: SparkSession, d: str) -> tuple[history.History, DataFrame, DataFrame]:
    """The history of all artifacts, the arrivals, and the texts that the history was made of."""
    new = table(spark, d, "arrival", True).select("arrival_id", "batch_no", *KEYS, "text")
    chunks = table(spark, d, "chunk", True).select("id", "text")
    store = history.History(spark, order=history.order_of(chunks.select("text"), new.select("text")), keys=KEYS)
    store.load(chunks, "id", "text", table(spark, d, "artifact").select(*KEYS))
    return store, new, chunks


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """All arrivals as one batch; their ids say which are earlier."""
    store, new, chunks = _history(spark, d)
    return store.accept(new, "arrival_id", "arrival_id", "text", chunks, "id", "text").select(F.col("own").alias("arrival_id"))


def p6_batches(spark: SparkSession, d: str) -> DataFrame:
    """The same batch by batch: each is checked against the history and then appended to it."""
    store, new, chunks = _history(spark, d)
    out = None
    for no in [r[0] for r in new.select("batch_no").distinct().orderBy("batch_no").collect()]:
        batch = new.filter(F.col("batch_no").eqNullSafe(F.lit(no)))
        earlier = new.filter(F.col("batch_no") < F.lit(no)) if no is not None else new.limit(0)
        found = store.accept(batch, "arrival_id", "arrival_id", "text", chunks, "id", "text", earlier).select(F.lit(no).cast("int").alias("batch_no"), F.col("own").alias("arrival_id"))
        out = found if out is None else out.unionByName(found)
    return out if out is not None else new.select("batch_no", "arrival_id").limit(0)


def _personal(spark: SparkSession, d: str) -> DataFrame:
    texts = pii.candidates(table(spark, d, "chunk", True), "id", "text", "chunk.text")
    mails = pii.candidates(table(spark, d, "artifact", True), "id", "author_email", "artifact.author_email")
    return pii.entities(texts.unionByName(mails))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _personal(spark, d).select("place", "row_id", "pii_type").distinct()


def p7_masked(spark: SparkSession, d: str) -> DataFrame:
    found = durable(_personal(spark, d), "personal")
    texts = pii.redact(table(spark, d, "chunk", True), "id", "text", found.filter("place = 'chunk.text'")).withColumn("place", F.lit("chunk.text"))
    mails = pii.redact(table(spark, d, "artifact", True), "id", "author_email", found.filter("place = 'artifact.author_email'")).withColumn("place", F.lit("artifact.author_email"))
    return texts.unionByName(mails).filter("n_found > 0").select("place", "row_id", "masked", "n_found")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents", True), "doc_id", "text")


def p8_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", True).select("doc_id", F.col("text").alias("_text"))
    back = tokens.decode(tokens.encode(docs, "doc_id", "_text"), "doc_id", "ids")
    same = back.join(docs, "doc_id").select("doc_id", (F.coalesce("_text", F.lit("")) == F.col("text")).alias("exact"))
    return same.groupBy("exact").agg(F.count("*").alias("n_docs"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix.mix(table(spark, d, "documents", True), table(spark, d, "mix_share"))[1]


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix.mix(table(spark, d, "documents", True), table(spark, d, "mix_share"))[0]


def p9_soft_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix.mix(table(spark, d, "documents", True), table(spark, d, "mix_share"), soft=True)[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.expanded(*spans.shared_pairs(table(spark, d, "documents", True), "doc_id", "text"))


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    return spans.shares(table(spark, d, "documents", True), "doc_id", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries by name."""
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1].isdigit()}
