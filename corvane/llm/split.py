"""Problem 1: splitting oversized texts and files at natural boundaries.

A text is cut in ranges of ``range_chars`` that are worked on apart from each other. A range is
read with a halo before it; the cut at its edge is the best boundary in the last half limit before
the edge, and because boundaries are found from their neighbourhood alone, both sides of an edge
choose the same cut without talking to each other. Within a range pieces are cut greedily. The
tables of the ranges are then stitched: prefix sums over the lengths and piece counts of earlier
ranges give offsets in the whole text and piece numbers. ``split_files`` does the same over byte
ranges of files that never are in memory as a whole, and emits the pieces by their offsets.

What a place is worth depends on at most BEHIND characters before and AHEAD after it, so the halo of
a range holds all that its edges are judged by, however long runs of blanks or marks are.

Defined results: null, empty and short texts and texts of a kind without a limit give no piece.
Every piece has at most ``max_chars`` characters; all but the first begin with the last
``overlap`` characters of what came before (with all of it where that is less). An overlap of the
limit or more counts as one under it, a negative or null one as 0; a null limit or one under 2
splits nothing. Ids must tell the rows apart."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.llm.arrow import flat_map

#: Characters of a range, and what is read before and after a place to tell what it is worth.
RANGE_CHARS, BEHIND, AHEAD = 1 << 16, 96, 128
#: Ranges whose prefix sums are made in one task; longer texts take a second level.
BLOCK = 1024
#: What a boundary is, best first; the last is a cut anywhere.
WORTH = ("section", "paragraph", "block", "line", "sentence", "word", "none")

_LINE = re.compile(r"(?:\r\n|\n|\r)(?=([ \t]{0,64})(\S?[^\n\r]{0,40}))")
_BLANK = re.compile(r"(?:\n|\r(?!\n))[ \t]{0,64}(?:\r\n|\n|\r)\Z")
_DEF = re.compile(r"(?:export |pub(?:\(crate\))? |async |default )*(?:def|class|func|fn|impl|function|interface|struct|enum|trait|mod|type|const \w+ = (?:async )?\(|@\w|#\[)")
_HEAD = re.compile(r"#{1,6} |```|-{3,}|={3,}|diff --git |@@ ")
_SENTENCE = re.compile(r"(?:[.!?][\"')\]]{0,8}|[;,{}])\s{1,64}(?=\S)")
_SPACE = re.compile(r"(?<=\s)(?=\S)")


def boundaries(text: str, code: bool) -> list[tuple[int, int]]:
    """(offset, worth) of every place where ``text`` may be cut well, in order. A place is judged
    by the characters around it only."""
    found: dict[int, int] = {}
    for m in _SPACE.finditer(text):
        found[m.end()] = 5
    for m in _SENTENCE.finditer(text):
        found[m.end()] = 4
    for m in _LINE.finditer(text):
        at, indent, begin = m.end(), len(m[1].expandtabs(4)), m[2]
        blank = bool(_BLANK.search(text, max(0, at - BEHIND + 16), at))
        if code:
            worth = 0 if blank and indent == 0 or indent == 0 and _DEF.match(begin) else 1 if blank or _DEF.match(begin) else 2 if indent <= 4 and begin[:1] not in ("}", ")", "]", "") else 3
        else:
            worth = 0 if _HEAD.match(begin) and indent == 0 else 1 if blank else 2 if begin[:2] in ("- ", "* ", "> ") else 3
        found[at] = worth
    return sorted(found.items())


def _whole(text: str, at: int) -> int:
    """``at`` or a place before it that is not within a line end or before a combining mark."""
    least = max(1, at - 16)
    while at > least and (at < len(text) and (unicodedata.combining(text[at]) or text[at] in "‍️" or text[at - 1] == "‍" or text[at - 1 : at + 1] == "\r\n")):
        at -= 1
    return at


class _Cuts:
    """Boundaries of a slice, for repeated choices."""

    def __init__(self, text: str, code: bool):
        self.text, self.all = text, boundaries(text, code)
        self.at = [x for x, _ in self.all]

    def best(self, low: int, high: int) -> tuple[int, int]:
        """The best boundary in (low, high], the last of equals; else a cut at ``high``."""
        from bisect import bisect_right

        most = None
        for k in range(bisect_right(self.at, low), bisect_right(self.at, high)):
            at, worth = self.all[k]
            if most is None or worth <= most[1]:
                most = (at, worth)
        return most or (_whole(self.text, high), 6)


def cut_range(text: str, left: int, right: int, first: bool, last: bool, limit: int, overlap: int, code: bool) -> list[tuple[int, int, int, int]]:
    """Pieces of a range as (begin, new, end, worth) in characters of its slice ``text``: the piece
    is text[begin:end], what is new in it begins at ``new``. ``left`` and ``right`` are where the
    range's own characters begin and end in the slice, the rest is halo."""
    cuts = _Cuts(text, code)
    begin = 0 if first else cuts.best(left - limit // 2, left)[0]
    end, last_worth = (right, 0) if last else cuts.best(right - limit // 2, right)
    out, at = [], begin
    while at < end:
        before = min(overlap, at) if first else overlap
        room = limit - before
        if end - at <= room:
            stop, worth = end, last_worth
        else:
            stop, worth = cuts.best(at + room // 2, at + room)
            if stop <= at:
                stop, worth = at + room, 6
        out.append((at - before, at, stop, worth))
        at = stop
    return out


def _limits(limit: Column, overlap: Column) -> tuple[Column, Column]:
    limit = limit.cast("int")
    return limit, F.least(F.greatest(F.coalesce(overlap.cast("int"), F.lit(0)), F.lit(0)), limit - 1)


def _prefix(ranges: DataFrame, key: str) -> DataFrame:
    """``ranges`` with ``_off`` and ``_no``: characters and pieces of the earlier ranges of the same
    key, and ``_total`` pieces. Two levels, so no task holds more than BLOCK ranges of one text."""
    ranges = ranges.withColumn("_block", F.floor(F.col("_range") / BLOCK))
    blocks = ranges.groupBy(key, "_block").agg(F.sum("_chars").alias("_bc"), F.sum("_pieces").alias("_bp"))
    earlier = W.partitionBy(key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(key, "_block", F.coalesce(F.sum("_bc").over(earlier), F.lit(0)).alias("_b0"), F.coalesce(F.sum("_bp").over(earlier), F.lit(0)).alias("_p0"), F.sum("_bp").over(W.partitionBy(key)).alias("_total"))
    within = W.partitionBy(key, "_block").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    return (
        ranges.select("*", F.coalesce(F.sum("_chars").over(within), F.lit(0)).alias("_c1"), F.coalesce(F.sum("_pieces").over(within), F.lit(0)).alias("_p1"))
        .join(blocks, [key, "_block"])
        .withColumns({"_off": F.col("_b0") + F.col("_c1"), "_no": F.col("_p0") + F.col("_p1")})
    )


def split_texts(df: DataFrame, id_col: str, text_col: str, limit: Column, overlap: Column, code: Column | None = None, range_chars: int = RANGE_CHARS) -> DataFrame:
    """Pieces of the texts of ``df`` that are longer than ``limit``: ``id_col``, piece_no (from 0),
    n_pieces, start_char, new_char, end_char (offsets in the text; the piece is [start, end), what
    is new in it [new, end)), boundary (a name of WORTH, of the cut at its end) and piece_text.
    Only texts over the limit are shuffled."""
    limit, overlap = _limits(limit, overlap)
    size = F.char_length(F.col(text_col))
    over = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), limit.alias("_limit"), overlap.alias("_over"), F.coalesce(code if code is not None else F.lit(False), F.lit(False)).alias("_code"), size.alias("_len")).filter((F.col("_limit") >= 2) & (F.col("_len") > F.col("_limit")))
    span = F.greatest(F.lit(range_chars), F.col("_limit") * 2)
    over = over.withColumn("_span", span).withColumn("_range", F.explode(F.sequence(F.lit(0), F.floor((F.col("_len") - 1) / F.col("_span")).cast("int"))))
    left = F.least(F.col("_range") * F.col("_span"), F.col("_limit") * 2 + BEHIND)
    at = F.col("_range") * F.col("_span") - left
    over = over.withColumns({"_left": left, "_own": F.least(F.col("_span"), F.col("_len") - F.col("_range") * F.col("_span"))})
    over = over.withColumn("_slice", F.col("_text").substr(at + 1, F.col("_left") + F.col("_own") + AHEAD))
    last = F.col("_range") == F.floor((F.col("_len") - 1) / F.col("_span"))
    kind = df.schema[id_col].dataType.simpleString()
    scanned = flat_map(
        over.select("_id", "_range", "_slice", "_left", "_own", last.alias("_last"), "_limit", "_over", "_code"),
        _scan,
        f"_id {kind}, _range int, _chars int, _pieces int, _cut array<struct<begin:int,new:int,end:int,worth:int,text:string>>",
    )
    done = _prefix(scanned, "_id").select("_id", "_off", "_no", "_total", F.posexplode("_cut").alias("_k", "_p"))
    return done.select(
        F.col("_id").alias(id_col),
        (F.col("_no") + F.col("_k")).cast("long").alias("piece_no"),
        F.col("_total").cast("long").alias("n_pieces"),
        (F.col("_off") + F.col("_p.begin")).cast("long").alias("start_char"),
        (F.col("_off") + F.col("_p.new")).cast("long").alias("new_char"),
        (F.col("_off") + F.col("_p.end")).cast("long").alias("end_char"),
        F.element_at(F.array(*map(F.lit, WORTH)), F.col("_p.worth") + 1).alias("boundary"),
        F.col("_p.text").alias("piece_text"),
    )


def _scan(key, number, text, left, own, last, limit, overlap, code) -> Iterator[tuple]:
    pieces = cut_range(text, left, left + own, number == 0, last, limit, overlap, code)
    yield key, number, own, len(pieces), [{"begin": b - left, "new": n - left, "end": e - left, "worth": w, "text": text[b:e]} for b, n, e, w in pieces]


# Files


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path and length of the files of a folder and those within it; no content is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "length")


def _read(path: str, at: int, size: int) -> bytes:
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    with where.open_input_file(name) as f:
        f.seek(max(0, at))
        return f.read(size + min(0, at))


def _range_of(path: str, number: int, span: int, halo: int, length: int) -> tuple[str, int, int]:
    """The slice of a byte range as text, and where its own characters begin and end in it. A
    character belongs to the range where its first byte lies."""
    begin = max(0, number * span - halo)
    raw = _read(path, begin, number * span + span + AHEAD * 4 - begin)

    def whole(at: int) -> int:
        at = min(at, len(raw))
        return next((k for k in range(at, min(at + 3, len(raw))) if raw[k] & 0xC0 != 0x80), min(at + 3, len(raw)))

    low, left, right = whole(0 if begin == 0 else 1), whole(number * span - begin), whole(min(length, (number + 1) * span) - begin)
    head, own = raw[low:left].decode("utf-8", "replace"), raw[left:right].decode("utf-8", "replace")
    return head + own + raw[right:].decode("utf-8", "ignore"), len(head), len(head) + len(own)


def split_files(files: DataFrame, max_chars: int, overlap_chars: int, code: bool = False, range_bytes: int = 1 << 23) -> DataFrame:
    """Pieces of UTF-8 files that have more than ``max_chars`` characters, from a table of path and
    length (see list_files): path and the columns of split_texts. Workers read byte ranges with
    halos; only boundary tables are shuffled, and the pieces' texts are read again by offset.
    Bytes that are no UTF-8 count as U+FFFD."""
    overlap = min(max(0, overlap_chars), max_chars - 1)
    halo = (max_chars * 2 + BEHIND) * 4
    span = max(range_bytes, 2 * halo)

    def scan(path: str, length: int, number: int) -> Iterator[tuple]:
        text, left, right = _range_of(path, number, span, halo, length)
        last = (number + 1) * span >= length
        pieces = cut_range(text, left, right, number == 0, last, max_chars, overlap, code)
        yield path, length, number, right - left, len(pieces), [{"begin": b - left, "new": n - left, "end": e - left, "worth": w} for b, n, e, w in pieces]

    ranges = files.filter(F.col("length") > max_chars).select("path", "length", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / span).cast("int"))).alias("_range"))
    ranges = ranges.repartition(F.col("path"), F.col("_range"))
    tables = flat_map(ranges, scan, "path string, length long, _range int, _chars int, _pieces int, _cut array<struct<begin:int,new:int,end:int,worth:int>>")
    stitched = _prefix(tables, "path").filter("_total > 1").select("path", "length", "_range", "_off", "_no", "_total", "_cut")

    def emit(path: str, length: int, number: int, off: int, no: int, total: int, cut: list[dict]) -> Iterator[tuple]:
        text, left, _ = _range_of(path, number, span, halo, length)
        for k, p in enumerate(cut):
            yield path, no + k, total, off + p["begin"], off + p["new"], off + p["end"], WORTH[p["worth"]], text[left + p["begin"] : left + p["end"]]

    return flat_map(stitched, emit, "path string, piece_no long, n_pieces long, start_char long, new_char long, end_char long, boundary string, piece_text string")


def tiling(pieces: DataFrame, id_col: str) -> DataFrame:
    """For each text that was split: ``id_col``, n_chars (its end), new_chars (characters that are new
    in one of its pieces) and longest (characters of its longest piece). A text is covered without gap
    or repeat where n_chars and new_chars are equal."""
    size = F.col("end_char") - F.col("new_char")
    return pieces.groupBy(id_col).agg(F.max("end_char").alias("n_chars"), F.sum(size).alias("new_chars"), F.max(F.char_length("piece_text")).cast("long").alias("longest"))


def found(pieces: DataFrame, id_col: str) -> DataFrame:
    """Ids of the texts that were split."""
    return pieces.filter((F.col("piece_no") == 0) & (F.col("n_pieces") > 1)).select(id_col)


