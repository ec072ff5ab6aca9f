"""Problem 10: long stretches that stand verbatim in more than one document.

Content-defined chunking with a gear rolling hash. A run of RUN chunks in a row is at most
``GEAR + WINDOW * (RUN + 1)`` characters from the begin of any stretch that holds it, so every
stretch of MIN_CHARS characters holds a whole run, and both documents cut it alike. Runs are
deduplicated by digest; what shares a digest is verified on the texts, by which chance digests
fall away and stretches get their full length.

Texts that stand whole in several documents are worked on once and expanded at the end. A digest
in more than HOT documents is no key by itself: of every window of MIN_CHARS that holds it the least
digest of a stretch of MIN_CHARS - STEP + 1 characters is the key, so documents that share a window
have a key in common and only those meet that share nearly one. Nothing is dropped. Where pairs
aren't asked for (``shares``), hot windows are counted by their digests, in time that grows with
the texts and not with their pairs.

Defined results: null, empty and short texts share nothing. Offsets are in characters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.llm.arrow import flat_map
from corvane.llm.gear import GEAR, WINDOW, Digests, boundaries, points
from corvane.runtime import durable

#: Least characters of a stretch; chunks in a run; documents from which on a digest is hot.
MIN_CHARS, RUN, HOT = 400, 4, 64
#: Stretches of a hot window of which the least is its key.
STEP = 48


def window_of(least: int) -> int:
    """The window for stretches of ``least`` characters: RUN chunks must fit after the first."""
    return min(WINDOW, (least - GEAR) // (RUN + 1))


def runs(text: str, least: int = MIN_CHARS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests, begins and ends of all runs of chunks of a text."""
    codes = points(text)
    at = boundaries(codes, window_of(least)) + 1
    if len(at) <= RUN:
        none = np.empty(0, np.int64)
        return none, none, none
    begin, end = at[:-RUN], at[RUN:]
    return Digests(codes).of(begin, end), begin, end


def _covered(hit: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Stretches (begin, end) that windows at the given begins cover together, where windows follow
    each other without a gap in their begins."""
    at = np.flatnonzero(hit)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > 1)
    first, last = at[np.concatenate(([0], cut + 1))], at[np.concatenate((cut, [len(at) - 1]))]
    return [(int(x), int(y) + least) for x, y in zip(first, last)]


def common(a: str, b: str, least: int = MIN_CHARS) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Stretches (begin, end) of ``a`` whose every window of ``least`` characters stands in ``b``, and
    those of ``b`` that stand in ``a``. The time is that of sorting, also for repetitive texts."""
    x, y = points(a), points(b)
    if min(len(x), len(y)) < least:
        return [], []
    begin = np.arange(len(x) - least + 1)
    p = Digests(x).of(begin, begin + least)
    begin = np.arange(len(y) - least + 1)
    q = Digests(y).of(begin, begin + least)
    in_a, in_b = _covered(np.isin(p, q), least), _covered(np.isin(q, p), least)
    # Digests of 64 bits say so; the texts themselves are asked at both ends of each stretch.
    in_a = [(i, j) for i, j in in_a if a[i : i + least] in b and a[j - least : j] in b]
    in_b = [(i, j) for i, j in in_b if b[i : i + least] in a and b[j - least : j] in a]
    return (in_a, in_b) if in_a and in_b else ([], [])


def _keys(key: int, text: str, least: int) -> Iterator[tuple]:
    digest, begin, end = runs(text, least)
    last = {}
    for d, b, e in zip(digest.tolist(), begin.tolist(), end.tolist()):
        last.setdefault(d, (b, e))
    for d, (b, e) in last.items():
        yield key, d


def _windows(text: str, hot: list[int], least: int) -> tuple[np.ndarray, np.ndarray]:
    """The code points of a text, and the begins of its windows of ``least`` characters that hold a
    hot run."""
    digest, begin, end = runs(text, least)
    hit = np.isin(digest, np.array(hot, np.int64))
    codes = points(text)
    n = len(codes)
    edge = np.zeros(n + 2, np.int64)
    np.add.at(edge, np.maximum(0, end[hit] - least), 1)
    np.add.at(edge, np.minimum(begin[hit], n - least) + 1, -1)
    return codes, np.flatnonzero(np.cumsum(edge)[: max(0, n - least + 1)] > 0)


def _hot_keys(key: int, text: str, hot: list[int], least: int) -> Iterator[tuple]:
    """For every window of ``least`` characters that holds a hot run, the least digest of its stretches
    of STEP characters less."""
    codes, at = _windows(text, hot, least)
    if not len(at):
        return
    step = min(STEP, least // 2)
    begin = np.arange(len(codes) - (least - step + 1) + 1)
    low = Digests(codes).of(begin, begin + least - step + 1)
    size = 1
    while size < step:
        more = min(size, step - size)
        low = np.minimum(low[:-more], low[more:])
        size += more
    for d in np.unique(low[at]).tolist():
        yield key, d


def _hot_windows(key: int, text: str, hot: list[int], least: int) -> Iterator[tuple]:
    """Digest and begin of every window of ``least`` characters that holds a hot run."""
    codes, at = _windows(text, hot, least)
    if len(at):
        yield from zip([key] * len(at), Digests(codes).of(at, at + least).tolist(), at.tolist())


_SPAN = "array<struct<begin:int,end:int>>"


def _shared_runs(docs: DataFrame, id_col: str, text_col: str, least: int, hot: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(firsts, copies, cold, burning): documents with different texts (_id, _text), copies as in
    shared_pairs, digests in 2 to ``hot`` documents with these, and the hot digests of documents."""
    if least < GEAR + RUN + 1:
        raise ValueError(f"least must be {GEAR + RUN + 1} or more")
    base = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).filter(F.char_length("_text") >= least)
    prints = base.select("_id", F.md5(F.col("_text").cast("binary")).alias("_print"))
    # One row a text that stands in several documents, then its documents; no task holds all copies.
    many = prints.groupBy("_print").agg(F.min("_id").alias("same_as"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    copies = durable(prints.join(many, "_print").filter("_id <> same_as").select(F.col("_id").alias("doc_id"), "same_as"), "copies")
    firsts = base.join(copies.select(F.col("doc_id").alias("_id")), "_id", "left_anti")
    keys = durable(flat_map(firsts, lambda k, t: _keys(k, t, least), "_id long, _digest long"), "runs")
    shared = durable(keys.join(keys.groupBy("_digest").agg(F.count("*").alias("_n")).filter("_n > 1"), "_digest"), "shared")
    cold = shared.filter(F.col("_n") <= hot).select("_digest", "_id")
    burning = shared.filter(F.col("_n") > hot).groupBy("_id").agg(F.collect_set("_digest").alias("_hot"))
    return firsts, copies, cold, burning


def _verified(firsts: DataFrame, keys: DataFrame, least: int) -> DataFrame:
    """Pairs of documents that have a key in common and do share a stretch; see shared_pairs."""
    left, right = keys.select("_digest", F.col("_id").alias("id_a")), keys.select("_digest", F.col("_id").alias("id_b"))
    candidates = left.join(right, "_digest").filter("id_a < id_b").select("id_a", "id_b").distinct()
    texts = firsts.join(candidates.select(F.explode(F.array("id_a", "id_b")).alias("_id")).distinct(), "_id", "left_semi")
    paired = candidates.join(texts.select(F.col("_id").alias("id_a"), F.col("_text").alias("text_a")), "id_a").join(texts.select(F.col("_id").alias("id_b"), F.col("_text").alias("text_b")), "id_b")

    def verify(a: int, b: int, x: str, y: str) -> Iterator[tuple]:
        in_a, in_b = common(x, y, least)
        if in_a:
            yield a, b, [{"begin": i, "end": j} for i, j in in_a], [{"begin": i, "end": j} for i, j in in_b]

    return flat_map(paired.select("id_a", "id_b", "text_a", "text_b"), verify, f"id_a long, id_b long, in_a {_SPAN}, in_b {_SPAN}")


def shared_pairs(docs: DataFrame, id_col: str, text_col: str, least: int = MIN_CHARS, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(pairs, copies). pairs: id_a < id_b of documents with different texts, each the first of its
    copies, and the stretches (begin, end) of each that stand in the other, ``in_a`` and ``in_b``.
    copies: doc_id and the first document ``same_as`` with the same text, for documents that aren't
    the first of theirs."""
    firsts, copies, cold, burning = _shared_runs(docs, id_col, text_col, least, hot)
    keys = flat_map(firsts.join(burning, "_id"), lambda k, t, h: _hot_keys(k, t, h, least), "_id long, _digest long")
    return _verified(firsts, cold.unionByName(keys.select("_digest", "_id")), least), copies


def expanded(pairs: DataFrame, copies: DataFrame) -> DataFrame:
    """All pairs of documents, copies included: doc_id_a < doc_id_b."""
    firsts = copies.select(F.col("same_as").alias("doc_id"), "same_as").distinct()
    member = copies.unionByName(firsts)
    a, b = member.select(F.col("same_as").alias("id_a"), F.col("doc_id").alias("_a")), member.select(F.col("same_as").alias("id_b"), F.col("doc_id").alias("_b"))
    wide = pairs.select("id_a", "id_b").join(a, "id_a", "left").join(b, "id_b", "left")
    wide = wide.select(F.coalesce("_a", "id_a").alias("_a"), F.coalesce("_b", "id_b").alias("_b"))
    same = a.withColumnRenamed("id_a", "_s").join(b.withColumnRenamed("id_b", "_s"), "_s").filter("_a < _b").select("_a", "_b")
    both = wide.unionByName(same)
    return both.select(F.least("_a", "_b").alias("doc_id_a"), F.greatest("_a", "_b").alias("doc_id_b"))


def shares(docs: DataFrame, id_col: str, text_col: str, least: int = MIN_CHARS, hot: int = HOT) -> DataFrame:
    """How much of each document stands elsewhere too: doc_id, n_chars, shared_chars, share and n_copies
    (other documents with the same text). Copies of whole texts are shared as a whole. Of stretches
    that few documents hold the pairs are verified; of others windows are counted."""
    firsts, copies, cold, burning = _shared_runs(docs, id_col, text_col, least, hot)
    pairs = durable(_verified(firsts, cold, least), "pairs")
    side = lambda own, held: pairs.select(F.col(own).alias("_id"), F.explode(held).alias("s")).select("_id", F.col("s.begin").alias("_b"), F.col("s.end").alias("_e"))
    windows = durable(flat_map(firsts.join(burning, "_id"), lambda k, t, h: _hot_windows(k, t, h, least), "_id long, _digest long, _b int"), "windows")
    found = windows.groupBy("_digest").agg(F.min("_id").alias("_x"), F.max("_id").alias("_y")).filter("_x < _y").select("_digest")
    hot_spans = windows.join(found, "_digest").select("_id", "_b", (F.col("_b") + least).alias("_e"))
    spans = side("id_a", "in_a").unionByName(side("id_b", "in_b")).unionByName(hot_spans)
    before = W.partitionBy("_id").orderBy("_b", "_e").rowsBetween(W.unboundedPreceding, -1)
    covered = spans.distinct().withColumn("_max", F.coalesce(F.max("_e").over(before), F.lit(0)))
    covered = covered.groupBy("_id").agg(F.sum(F.greatest(F.lit(0), F.col("_e") - F.greatest("_b", "_max"))).alias("_shared"))
    sizes = copies.groupBy("same_as").agg(F.count("*").alias("_n"))
    copied = copies.select(F.col("doc_id").alias("_doc"), "same_as").unionByName(copies.select(F.col("same_as").alias("_doc"), "same_as").distinct()).join(sizes, "same_as")
    base = docs.select(F.col(id_col).cast("long").alias("_doc"), F.coalesce(F.char_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_chars"))
    base = base.join(copied, "_doc", "left").withColumn("_id", F.coalesce("same_as", "_doc")).join(covered, "_id", "left")
    whole = F.when(F.col("same_as").isNotNull(), F.col("n_chars")).otherwise(F.coalesce("_shared", F.lit(0))).cast("long")
    return base.select(F.col("_doc").alias("doc_id"), "n_chars", whole.alias("shared_chars"), F.when(F.col("n_chars") > 0, F.round(whole / F.col("n_chars"), 6)).otherwise(F.lit(0.0)).alias("share"), F.coalesce("_n", F.lit(0)).cast("long").alias("n_copies"))
