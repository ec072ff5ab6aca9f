import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.llm import split


def _check(text, pieces, limit, overlap):
    at = 0
    for k, p in enumerate(sorted(pieces, key=lambda p: p.piece_no)):
        assert p.piece_no == k and p.n_pieces == len(pieces)
        assert p.piece_text == text[p.start_char : p.end_char] and 0 < len(p.piece_text) <= limit
        assert p.new_char == at and (k == 0 or p.new_char - p.start_char == min(overlap, p.new_char))
        at = p.end_char
    assert at == len(text)


def _text(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choice(["word ", "Größe. ", "\n\n", "\r\n", "\n    x = 1\n", "def f():\n", "é", "😀", "-" * 30, "\t"]) for _ in range(n))


@pytest.mark.parametrize("code", [True, False])
def test_pieces_cover_the_text(spark, code):
    texts = {1: _text(1, 3000), 2: "x" * 5000, 3: "short", 4: "", 5: None, 6: "a" * 101, 7: "\r\n" * 300, 8: " " * 999}
    df = spark.createDataFrame([(k, t, 9, 9) for k, t in texts.items()], "id long, text string, piece_no int, _len int")
    for span in (64, 300, 1 << 16):
        got = split.split_texts(df, "id", "text", F.lit(100), F.lit(20), F.lit(code), range_chars=span).collect()
        by = {k: [p for p in got if p.id == k] for k in texts}
        assert {k for k, v in by.items() if v} == {1, 2, 6, 7, 8} == {r.id for r in split.found(split.split_texts(df, "id", "text", F.lit(100), F.lit(20)), "id").collect()}
        for k, pieces in by.items():
            if pieces:
                _check(texts[k], pieces, 100, 20)


@given(st.text(alphabet="ab \n.\r\t#", min_size=0, max_size=400), st.integers(2, 40), st.integers(0, 50))
@settings(max_examples=200, deadline=None)
def test_cuts_hold_for_any_text(text, limit, overlap):
    overlap = min(overlap, limit - 1)
    if len(text) <= limit:
        return
    at = 0
    for begin, new, end, _ in split.cut_range(text, 0, len(text), True, True, limit, overlap, False):
        assert new == at and end - begin <= limit and end > new
        at = end
    assert at == len(text)


def _ranges(text, span, limit, overlap, code):
    """Pieces by cut_range in ranges of ``span`` with the slices that split_texts makes."""
    out, at, n = [], 0, -(-len(text) // span)
    for k in range(n):
        left = min(k * span, limit * 2 + split.BEHIND)
        own = min(span, len(text) - k * span)
        part = text[k * span - left : k * span + own + split.AHEAD]
        out += [(b - left + k * span, x - left + k * span, e - left + k * span) for b, x, e, _ in split.cut_range(part, left, left + own, k == 0, k == n - 1, limit, overlap, code)]
    return out


def test_ranges_agree_at_their_edges():
    rng = random.Random(17)
    units = ["word ", "Go on. ", "\n\n", "\r\n", "\r", "\n    x = 1\n", "def f():\n", "é\u0301", "e\u0301\u0301\u0301", "👩\u200d🔧", "-" * 30, "\t", " " * 70, " " * 150, " " * 300, "\t" * 200, ". " + " " * 90, '.)"' + " " * 65, "\n" + " " * 130 + "x", "\n" + " " * 70 + "\n"]
    for _ in range(10_000):
        mine = rng.sample(units, rng.randint(1, 6))
        text = "".join(rng.choice(mine) for _ in range(rng.randint(5, 120)))
        limit = rng.choice([2, 3, 7, 20, 50, 120])
        span = max(rng.choice([16, 64, 150, 400]), limit * 2)
        overlap = rng.choice([0, 1, limit // 2, limit - 1])
        if len(text) <= limit or len(text) > 6000:
            continue
        at, code = 0, rng.random() < 0.5
        for begin, new, end in _ranges(text, span, limit, overlap, code):
            assert new == at and 0 < end - begin <= limit and new - begin == min(overlap, new) and end > new
            at = end
        assert at == len(text)


def test_a_line_end_of_two_signs_is_no_blank_line():
    assert dict(split.boundaries("a\r\nb", False))[3] == 3 and dict(split.boundaries("a\r\n\r\nb", False))[5] == 1
    assert dict(split.boundaries("a\r\rb", False))[3] == 1 and split.boundaries(" " * 200_000, False) == []


def test_cuts_fall_where_text_allows():
    text = "First paragraph is here.\n\nSecond paragraph is longer than it.\n\nThird one."
    cuts = [text[n:e] for _, n, e, _ in split.cut_range(text, 0, len(text), True, True, 45, 0, False)]
    assert cuts[0] == "First paragraph is here.\n\n" and cuts[1].endswith("\n\n")
    source = "def a():\n    x = 1\n    y = 2\n\ndef b():\n    return 3\n"
    assert [source[n:e] for _, n, e, _ in split.cut_range(source, 0, len(source), True, True, 32, 0, True)][1].startswith("def b")


def test_odd_limits(spark):
    df = spark.createDataFrame([(1, "abcdef", 3, 99), (2, "abcdef", None, 1), (3, "abcdef", 1, 0), (4, "abcdef", 3, None), (5, "abcdef", 4, -5)], "id long, text string, m int, o int")
    got = split.split_texts(df, "id", "text", F.col("m"), F.col("o")).collect()
    assert {r.id for r in got} == {1, 4, 5}
    first = sorted((r for r in got if r.id == 1), key=lambda r: r.piece_no)
    assert [r.piece_text for r in first] == ["abc", "bcd", "cde", "def"] and split.tiling(spark.createDataFrame(first), "id").first()[1:] == (6, 6, 3)
    _check("abcdef", [r for r in got if r.id == 4], 3, 0)
    assert split.split_texts(df.limit(0), "id", "text", F.col("m"), F.col("o")).count() == 0


def test_files_are_read_in_ranges(spark, tmp_path):
    texts = {"a.txt": _text(5, 20000), "b.txt": "é" * 3001, "small.txt": "tiny", "empty.txt": ""}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, newline="")
    files = split.list_files(spark, str(tmp_path), "*.txt")
    assert files.count() == 3  # the reader lists no empty files
    for size in (4096, 1 << 20):
        got = split.split_files(files, 500, 50, range_bytes=size).collect()
        assert {r.path.rsplit("/", 1)[1] for r in got} == {"a.txt", "b.txt"}
        for name in ("a.txt", "b.txt"):
            _check(texts[name], [r for r in got if r.path.endswith("/" + name)], 500, 50)
