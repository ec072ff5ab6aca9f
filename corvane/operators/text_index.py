"""Keyword search with BM25 over statistics of the whole index.

Terms are lower-case runs of letters, digits and underscores; with ``stem`` also without accents and
reduced by Porter's rules, which is done once for each distinct term and joined back. A query is a
conjunction of groups, a group a choice of phrases, a phrase one term or several that must follow
each other. Hits of each distinct phrase are looked up once for all queries; candidates of a query are
the texts that hold its rarest group, and only these meet the hits of its other phrases."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corvane.functions.expand import QueryExpander
from corvane.functions.porter import stem as porter
from corvane.runtime import durable, unsent
from corvane.schema import B, IDF_FLOOR, K1, TOP

_TERM = r"[\p{L}\p{N}\p{M}_]+"
ASCII_TERM = "[a-z0-9_]+"


def fold(term: str) -> str:
    """A term without accents, stemmed."""
    plain = "".join(c for c in unicodedata.normalize("NFD", term) if not unicodedata.combining(c))
    return porter(unicodedata.normalize("NFC", plain))


def _fold_all(terms: pd.Series) -> pd.Series:
    return terms.map(fold, na_action="ignore")


def _folded(column: str) -> Column:
    return F.pandas_udf(_fold_all, StringType())(F.col(column))


def raw_terms(text: Column, ascii_only: bool = False) -> Column:
    """The terms of a text in order, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(ASCII_TERM if ascii_only else _TERM), F.lit(0))


def postings(texts: DataFrame, id_col: str, text_col: str, stem: bool = False, ascii_only: bool = False) -> DataFrame:
    """chunk_id, term and pos of every term. Null and empty texts have none."""
    rows = texts.select(F.col(id_col).cast("long").alias("chunk_id"), F.posexplode(raw_terms(F.col(text_col), ascii_only)).alias("pos", "term"))
    if not stem:
        return rows.select("chunk_id", "term", "pos")
    forms = rows.select("term").distinct().withColumn("_form", _folded("term"))
    return rows.join(forms, "term").select("chunk_id", F.col("_form").alias("term"), "pos")


def index(posts: DataFrame) -> DataFrame:
    """Postings put together as an index stores them: term, chunk_id and ``at``, the places of the term
    in the text in order."""
    return posts.groupBy("term", "chunk_id").agg(F.sort_array(F.collect_list("pos")).alias("at"))


def lengths(posts: DataFrame) -> DataFrame:
    """chunk_id and len (terms) of texts with terms."""
    return posts.groupBy("chunk_id").agg(F.count("*").alias("len"))


def sizes_of(texts: DataFrame, id_col: str, text_col: str, ascii_only: bool = False) -> DataFrame:
    """The same straight from texts, without a shuffle."""
    return texts.select(F.col(id_col).cast("long").alias("chunk_id"), F.size(raw_terms(F.col(text_col), ascii_only)).cast("long").alias("len")).filter("len > 0")


def phrases_of(queries: DataFrame, stem: bool = False, ascii_only: bool = False) -> DataFrame:
    """query_id, grp, phrase and terms of queries (query_id, groups: arrays of arrays of words). A
    word without terms is left out, and so is a group without phrases."""
    rows = queries.select("query_id", F.posexplode("groups").alias("grp", "_words")).select("query_id", "grp", F.explode("_words").alias("_word"))
    rows = rows.withColumn("terms", raw_terms(F.col("_word"), ascii_only)).filter(F.size("terms") > 0)
    if stem:
        exploded = rows.select("query_id", "grp", "_word", F.posexplode("terms").alias("_at", "term")).withColumn("term", _folded("term"))
        rows = exploded.groupBy("query_id", "grp", "_word").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "term"))), lambda s: s["term"]).alias("terms"))
    return rows.select("query_id", "grp", F.array_join("terms", " ").alias("phrase"), "terms").distinct()


def plain_queries(queries: DataFrame, text_col: str = "query") -> DataFrame:
    """query_id and groups of queries whose words, parted by white space, are all required."""
    words = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\s+"), lambda w: w != "")
    return queries.select("query_id", F.transform(words, lambda w: F.array(w)).alias("groups"))


def expanded_queries(queries: DataFrame, expander: QueryExpander, text_col: str = "query") -> DataFrame:
    """query_id and groups of queries, each word with what may stand for it."""
    groups = F.udf(lambda text: expander.expand(text or ""), "array<array<string>>")
    return queries.select("query_id", groups(F.col(text_col)).alias("groups"))


def expression(groups: Column) -> Column:
    """Groups as a keyword expression: words quoted, those of a group joined by OR in parentheses,
    groups by AND; no group gives ``""``."""
    quoted = lambda w: F.concat(F.lit('"'), F.replace(w, F.lit('"'), F.lit('""')), F.lit('"'))
    said = F.transform(groups, lambda g: F.when(F.size(g) > 1, F.concat(F.lit("("), F.array_join(F.transform(g, quoted), " OR "), F.lit(")"))).otherwise(quoted(F.get(g, F.lit(0)))))
    return F.when(F.size(groups) > 0, F.array_join(said, " AND ")).otherwise('""')


def phrase_hits(posts: DataFrame, phrases: DataFrame) -> DataFrame:
    """phrase, chunk_id and f: how often each distinct phrase stands in each text. ``posts`` as postings
    or index gives them."""
    wanted = phrases.select("phrase", "terms").distinct()
    words = wanted.select("phrase", F.size("terms").alias("_n"), F.posexplode("terms").alias("_at", "term"))
    met = posts.join(words, "term")
    if "at" in posts.columns:
        single = met.filter("_n = 1").select("phrase", "chunk_id", F.size("at").cast("long").alias("f"))
        met = met.filter("_n > 1").withColumn("pos", F.explode("at"))
    else:
        single = met.filter("_n = 1").groupBy("phrase", "chunk_id").agg(F.count("*").alias("f"))
    rows = met.filter("_n > 1").groupBy("phrase", "chunk_id", "_n", (F.col("pos") - F.col("_at")).alias("_begin")).agg(F.count("*").alias("_k"))
    several = rows.filter("_k = _n").groupBy("phrase", "chunk_id").agg(F.count("*").alias("f"))
    return single.unionByName(several)


def bm25(posts: DataFrame, phrases: DataFrame, candidates: DataFrame | None = None, k: int | None = TOP, n_texts: DataFrame | None = None, sizes: DataFrame | None = None, objects: DataFrame | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """query_id, chunk_id, score and rank of the texts that fit each query, the best k of each (all if
    None); less is better, ties by chunk_id. Every phrase of a query that stands in a text counts.
    ``candidates`` (chunk_id) filters hits and changes no score. ``n_texts`` is one row with the number
    of texts of the index, those without terms included; by default texts with terms are counted.
    ``sizes`` (chunk_id, len) are the texts' terms, if they are known more cheaply than by counting.
    With ``objects`` (chunk_id, object) only the best text of each object is a hit."""
    sizes = sizes if sizes is not None else lengths(posts)
    counted = n_texts.toDF("_docs") if n_texts is not None else sizes.agg(F.count("*").alias("_docs"))
    # Both are one row.
    total = sizes.agg(F.sum("len").alias("_sum")).crossJoin(F.broadcast(counted)).select("_docs", (F.col("_sum") / F.col("_docs")).alias("_avg"))
    # Read several times below; written once, the queries' source isn't read and planned again in each place,
    # and their words are known to be few, so the index isn't shuffled to meet them.
    phrases = durable(phrases, "phrases")
    # Read three times below; written once, the postings are scanned once for all phrases.
    hits = durable(phrase_hits(posts, phrases), "hits")
    spread = hits.groupBy("phrase").agg(F.count("*").alias("_df"))
    asked = durable(phrases.select("query_id", "grp", "phrase").distinct().join(spread, "phrase", "left").fillna(0, ["_df"]), "asked")
    groups = asked.groupBy("query_id", "grp").agg(F.sum("_df").alias("_cost"))
    first = W.partitionBy("query_id").orderBy("_cost", "grp")
    groups = groups.select("query_id", "grp", F.row_number().over(first).alias("_no"), F.count("*").over(W.partitionBy("query_id")).alias("_groups"))
    rarest = asked.join(groups.filter("_no = 1").select("query_id", "grp", "_groups"), ["query_id", "grp"])
    pairs = rarest.select("query_id", "phrase", "_groups").join(unsent(hits.select("phrase", "chunk_id")), "phrase").select("query_id", "chunk_id", "_groups").distinct()
    if candidates is not None:
        pairs = pairs.join(unsent(candidates), "chunk_id", "left_semi")
    full = pairs.join(asked, "query_id").join(unsent(hits), ["phrase", "chunk_id"])
    idf = F.log((F.col("_docs") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    # The statistics are one row.
    full = full.join(unsent(sizes), "chunk_id").crossJoin(F.broadcast(total)).withColumn("_idf", F.when(idf <= 0, IDF_FLOOR).otherwise(idf))
    part = F.col("_idf") * F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * F.col("len") / F.col("_avg")))
    # A phrase that stands in several groups of a query counts in each of them.
    scored = full.groupBy("query_id", "chunk_id", "_groups").agg((-F.sum(part)).alias("score"), F.count_distinct("grp").alias("_met")).filter("_met = _groups")
    if objects is not None:
        best = F.min(F.struct(F.round("score", 8).alias("_round"), "chunk_id", "score")).alias("_best")
        scored = scored.join(unsent(objects.select("chunk_id", "object")), "chunk_id").groupBy("query_id", "object").agg(best).select("query_id", "_best.chunk_id", "_best.score")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.round("score", 8), "chunk_id"))
    ranked = scored.select("query_id", "chunk_id", "score").withColumn("rank", rank)
    return ranked if k is None else ranked.filter(F.col("rank") <= k)
