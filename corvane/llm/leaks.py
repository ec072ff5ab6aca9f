"""Problem 3: evaluation texts that leaked into a corpus.

The q-gram lemma as a filter: a stretch of n characters of an item that stands in a document with
at most k edits shares at least n - Q + 1 - k*Q of its q-grams with it, and all of them lie in a
band of diagonals k wide. Both texts are reduced to words (runs of ASCII letters and digits in
lower case, joined by one space). Shared q-grams are counted in overlapping bands of diagonals;
bands that reach the bound are aligned within the band, and the alignment says how much leaked.

Items are the stated query set; they meet all documents in blocks of bounded size, a pass over
the documents for each block, so what is sent to the workers doesn't grow with their number.

Defined results: null, blank and short items leak nowhere; null and empty documents hold nothing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.arrow import flat_map
from corvane.llm.gear import mix

#: Characters of a q-gram, least words of a leak, edits for each character of the shortest leak.
Q, MIN_WORDS, EDIT_RATE = 20, 15, 0.015
#: Items of a block, and characters of an item's text above which it counts as more than one.
BLOCK_ITEMS, BLOCK_CHARS = 2000, 2000
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def normal(text: str | None) -> bytes:
    """The words of a text, joined by single spaces."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split())


def grams(data: bytes) -> np.ndarray:
    """Hashes of all q-grams."""
    x = np.frombuffer(data, np.uint8)
    if len(x) < Q:
        return np.empty(0, np.uint64)
    h = x.astype(np.uint64) + np.uint64(1)
    size, base = 1, 0x100000001B3
    with np.errstate(over="ignore"):
        while size < Q:
            step = min(size, Q - size)
            h = h[:-step] * np.uint64(pow(base, step, 1 << 64)) + h[step:] if step == size else _extend(h, x, size, step, base)
            size += step
    return mix(h)


def _extend(h: np.ndarray, x: np.ndarray, size: int, step: int, base: int) -> np.ndarray:
    for k in range(step):
        h = h[:-1] * np.uint64(base) + (x[size + k :].astype(np.uint64) + np.uint64(1))
    return h


class Index:
    """The q-grams of a block of items: a bitmap that most q-grams of documents fail, then a sorted
    list with their places."""

    def __init__(self, items: list[tuple[int, str, bytes]], min_words: int, edit_rate: float):
        self.items, self.min_words = items, min_words
        self.bands = max(2, int(edit_rate * 8 * min_words) + 1)
        self.least = [self.bound(data, edit_rate) for _, _, data in items]
        hashes, which, at = [], [], []
        for k, (_, _, data) in enumerate(items):
            if data.count(b" ") + 1 >= min_words:
                h = grams(data)
                hashes.append(h)
                which.append(np.full(len(h), k, np.int32))
                at.append(np.arange(len(h), dtype=np.int32))
        none = np.empty(0, np.int32)
        h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hashes = h[order]
        self.which = np.concatenate(which)[order] if hashes else none
        self.at = np.concatenate(at)[order] if hashes else none
        self.bitmap = np.zeros(1 << 22, bool)
        self.bitmap[(self.hashes >> np.uint64(42)).astype(np.int64)] = True

    def bound(self, data: bytes, edit_rate: float) -> int:
        """q-grams that a leak of the least words of this item keeps within its budget of edits."""
        sizes = np.array([len(w) + 1 for w in data.split()])
        if len(sizes) < self.min_words:
            return 1 << 30
        least = int(np.convolve(sizes, np.ones(self.min_words, int), "valid").min()) - 1
        return max(1, least - Q + 1 - int(edit_rate * least) * Q)

    def candidates(self, data: bytes) -> Iterator[tuple[int, int, int, int]]:
        """(item, low diagonal, first and last place in ``data``) of bands that reach the bound."""
        h = grams(data)
        place = np.flatnonzero(self.bitmap[(h >> np.uint64(42)).astype(np.int64)])
        if not len(place):
            return
        h = h[place]
        low, high = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
        count = high - low
        if not count.any():
            return
        place, low, count = place[count > 0], low[count > 0], count[count > 0]
        spot = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        place = np.repeat(place, count)
        item, diagonal = self.which[spot].astype(np.int64), place - self.at[spot]
        for shift in (0, self.bands // 2):
            band = (diagonal + shift) // self.bands
            key = (item << 40) + (band + (1 << 38))
            order = np.lexsort((place, key))
            k, p = key[order], place[order]
            cut = np.flatnonzero(np.diff(k)) + 1
            for a, b in zip(np.concatenate(([0], cut)), np.concatenate((cut, [len(k)]))):
                least = self.least[k[a] >> 40]
                if b - a >= least and len(np.unique(p[a:b])) >= least:
                    yield int(k[a] >> 40), int((k[a] & ((1 << 40) - 1)) - (1 << 38)) * self.bands - shift, int(p[a]), int(p[b - 1]) + Q


def align(item: list[bytes], doc: list[bytes], shift: int, band: int) -> tuple[int, int, int, int, int]:
    """Banded local alignment of words: a cell (i, j) with |j - i - shift| <= band counts. Gives the
    longest run of equal words (length, end in item, end in doc), the words matched by the best
    alignment and its edits."""
    best_run, end_i, end_j, best_score, matched, edits = 0, 0, 0, 0, 0, 0
    runs: dict[int, int] = {}
    cells: dict[int, tuple[int, int, int]] = {}
    for i, word in enumerate(item):
        next_runs: dict[int, int] = {}
        next_cells: dict[int, tuple[int, int, int]] = {}
        for j in range(max(0, i + shift - band), min(len(doc), i + shift + band + 1)):
            score, m, e = cells.get(j - 1, (0, 0, 0))
            if word == doc[j]:
                run = next_runs[j] = runs.get(j - 1, 0) + 1
                if run > best_run:
                    best_run, end_i, end_j = run, i + 1, j + 1
                here = (score + 1, m + 1, e)
            else:
                up, left = cells.get(j, (0, 0, 0)), next_cells.get(j - 1, (0, 0, 0))
                here = max((score - 2, -e - 1, m), (up[0] - 2, -up[2] - 1, up[1]), (left[0] - 2, -left[2] - 1, left[1]))
                here = (here[0], here[2], -here[1]) if here[0] > 0 else (0, 0, 0)
            next_cells[j] = here
            if here[0] > best_score:
                best_score, matched, edits = here
        runs, cells = next_runs, next_cells
    return best_run, end_i, end_j, matched, edits


def _leaks(index: Index, key: int, text: str | None) -> Iterator[tuple]:
    data = normal(text)
    found: dict[int, tuple] = {}
    for k, diagonal, first, last in index.candidates(data):
        number, field, item = index.items[k]
        slack = 8 * index.bands
        a, b = max(0, first - slack), min(len(data), last + slack)
        a, b = data.rfind(b" ", 0, a) + 1, (len(data) if data.find(b" ", b) < 0 else data.find(b" ", b))
        p, q = max(0, a - diagonal - slack), min(len(item), b - diagonal + slack)
        p, q = item.rfind(b" ", 0, p) + 1, (len(item) if item.find(b" ", q) < 0 else item.find(b" ", q))
        anchor = data.count(b" ", a, max(a, first)) - item.count(b" ", p, max(p, first - diagonal))
        run, end_i, end_j, matched, edits = align(item[p:q].split(), data[a:b].split(), anchor, index.bands + 4)
        if matched >= index.min_words and (k not in found or (run, matched) > found[k][5:7]):
            found[k] = (key, number, field, data.count(b" ", 0, a) + end_j - run, item.count(b" ", 0, p) + end_i - run, run, matched, edits)
    yield from found.values()


def find_leaks(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str, fields: list[str], min_words: int = MIN_WORDS, edit_rate: float = EDIT_RATE, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """For each document and field of an item that leaks into it: doc_id, item_id, field, doc_word
    and item_word (where the longest exact run begins), run_words (its words), matched_words and
    edits of the best alignment."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    weight = sum((F.floor(F.coalesce(F.char_length(F.col(f)), F.lit(0)) / BLOCK_CHARS) + 1 for f in fields), F.lit(0))
    total = items.agg(F.sum(weight)).first()[0] or 0
    blocks = max(1, -(-int(total) // (block_items * len(fields))))
    ddl = "doc_id long, item_id long, field string, doc_word int, item_word int, run_words int, matched_words int, edits int"
    out = None
    for number in range(blocks):
        part = items.filter(F.pmod(F.xxhash64(F.col(item_col)), F.lit(blocks)) == number) if blocks > 1 else items
        rows = part.select(F.col(item_col).cast("long"), *fields).collect()
        index = spark.sparkContext.broadcast(Index([(r[0], f, normal(r[k + 1])) for r in rows for k, f in enumerate(fields)], min_words, edit_rate))
        leaks = flat_map(base, lambda key, text, index=index: _leaks(index.value, key, text), ddl)
        out = leaks if out is None else out.unionByName(leaks)
    return out


def exact(leaks: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id and item_id of leaks with a run of at least ``min_words`` equal words."""
    return leaks.filter(F.col("run_words") >= min_words).select("doc_id", "item_id").distinct()
