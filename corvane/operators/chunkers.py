"""Text into chunks: windows of lines, added blocks and hunks of diffs, syntax nodes, messages, notes.

What columns can say stays in the JVM (windows, blocks, messages, summaries); the parsers of diffs,
syntax trees and notes are functions of one text that run over Arrow batches."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from corvane.functions.languages import of_name
from corvane.functions.scalars import is_blank, strip
from corvane.operators.syntax import brace_nodes
from corvane.schema import AST_MAX, BODY_MAX, DOC_MAX, LEAST, MESSAGE_MIN, NOTE_MAX, OVERLAP, WINDOW


def per_row(df: DataFrame, rows: Callable[..., Iterable[tuple]], ddl: str) -> DataFrame:
    """The rows that ``rows(*columns)`` gives for each row of ``df``."""
    target = to_arrow_schema(_parse_datatype_string(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [row for values in zip(*(c.to_pylist() for c in batch.columns)) for row in rows(*values)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, type=target.field(k).type) for k, v in enumerate(zip(*out))], schema=target)

    return df.toDF(*(f"_{k}" for k in range(len(df.columns)))).mapInArrow(run, ddl)


def line_windows(df: DataFrame, id_col: str, text_col: str, size: int = WINDOW, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """id, start_line, end_line (from 1) and text of windows of ``size`` lines that overlap. A text
    with fewer than ``least`` lines has none, nor does the tail that a window already covers. A line
    end at the end of the text begins no line."""
    lines = F.split(F.regexp_replace(F.col(text_col), r"\n\z", ""), "\n")
    base = df.filter(F.col(text_col) != "").select(F.col(id_col).alias("id"), lines.alias("_lines"), F.size(lines).alias("_n")).filter(F.col("_n") >= least)
    step = size - overlap
    last = F.ceil(F.greatest(F.col("_n") - size, F.lit(0)) / step).cast("int") * step
    base = base.withColumn("_at", F.explode(F.sequence(F.lit(0), last, F.lit(step))))
    end = F.least(F.col("_at") + size, F.col("_n"))
    # A window of fewer lines than the least says nothing.
    return base.filter(end - F.col("_at") >= least).select("id", (F.col("_at") + 1).alias("start_line"), end.alias("end_line"), F.array_join(F.slice("_lines", F.col("_at") + 1, size), "\n").alias("text"))


def added_blocks(df: DataFrame, id_col: str, text_col: str, size: int = WINDOW, least: int = LEAST) -> DataFrame:
    """id, block (from 1 in each text) and text of runs of added lines of a diff, by gaps and islands.
    Long runs are cut at ``size`` lines; runs and tails under ``least`` lines are left out."""
    rows = df.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "line"))
    rows = rows.filter(F.col("line").startswith("+") & ~F.col("line").startswith("+++"))
    order = W.partitionBy("id").orderBy("pos")
    rows = rows.withColumn("_island", F.col("pos") - F.row_number().over(order))
    rows = rows.withColumn("_part", F.floor((F.row_number().over(W.partitionBy("id", "_island").orderBy("pos")) - 1) / size))
    blocks = rows.groupBy("id", "_island", "_part").agg(F.min("pos").alias("_first"), F.count("*").alias("n_lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda s: F.substring(s["line"], 2, 2**30)), "\n").alias("text"))
    blocks = blocks.filter(F.col("n_lines") >= least)
    return blocks.select("id", F.row_number().over(W.partitionBy("id").orderBy("_first")).alias("block"), "n_lines", "text")


def hunks_of(diff: str | None) -> Iterator[tuple[str, int, int, str, list[int]]]:
    """(path, number of the hunk, its first line, text after the change, numbers of its added lines) of
    each hunk of a unified diff. Binary files, deleted files and marks of missing line ends are passed over."""
    path, body, start, number, binary = None, None, 0, 0, False

    def flush() -> Iterator[tuple[str, int, int, str, list[int]]]:
        if path and body and not binary:
            text, added, line = [], [], start
            for raw in body:
                if raw.startswith("-"):
                    continue
                if raw.startswith("+"):
                    added.append(line)
                text.append(raw[1:] if raw[:1] in "+ " else raw)
                line += 1
            yield path, number, start, "\n".join(text), added

    for raw in (diff or "").split("\n"):
        if raw.startswith("diff --git "):
            yield from flush()
            found = re.search(r" b/(.+)$", raw)
            path, body, number, binary = (found[1] if found else None), None, 0, False
        elif body is None and raw.startswith("Binary files ") or raw.startswith("GIT binary patch"):
            binary = True
        elif raw.startswith("+++ ") and body is None:
            path = None if raw[4:].strip() == "/dev/null" else re.sub(r"^b/", "", raw[4:].split("\t")[0])
        elif raw.startswith("@@"):
            yield from flush()
            found = re.match(r"@@ -\d+(?:,\d+)? \+(\d+)", raw)
            body, start, number = [], int(found[1]) if found else 1, number + 1
        elif body is not None and not raw.startswith("\\"):
            body.append(raw)
    if body and body[-1] == "":
        body.pop()
    yield from flush()


def diff_hunks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, path, hunk, text (after the change) and added_lines of the hunks of diffs."""

    def rows(key: int, text: str | None) -> Iterator[tuple]:
        for path, number, _, after, added in hunks_of(text):
            yield key, path, number, after, added

    return per_row(df.select(F.col(id_col).cast("long"), F.col(text_col)), rows, "id long, path string, hunk int, text string, added_lines array<int>")


def leading_doc(text: str | None) -> str | None:
    """Documentation without signs of comments, on one line, cut at a length; None if nothing is left."""
    lines = [re.sub(r"^\s*(?:/\*+!?|\*+/|\*|//[/!]?|#+!?|\"\"\"|''')?|(?:\*+/|\"\"\"|''')?\s*$", "", x).strip() for x in (text or "").splitlines()]
    said = " ".join(x for x in lines if x)
    return (said if len(said) <= DOC_MAX else said[: DOC_MAX - 1].rstrip() + "…") or None


def syntax_nodes(text: str | None) -> list[tuple[int, int, str, str, str | None]] | None:
    """(first line, last line, kind, symbol, doc) of the functions, classes and methods of Python
    source, an outer node before those in it; None if it can't be read."""
    if text is None or len(text.encode("utf-8", "surrogatepass")) > AST_MAX:
        return None
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    lines = text.split("\n")
    out: list[tuple[int, int, str, str, str | None]] = []

    def walk(node: ast.AST) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                first = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                kind = "decorated_definition" if child.decorator_list else "class_definition" if isinstance(child, ast.ClassDef) else "function_definition"
                doc = ast.get_docstring(child)
                if doc is None:
                    above = []
                    for k in range(first - 2, -1, -1):
                        if not lines[k].lstrip().startswith("#"):
                            break
                        above.append(lines[k])
                    doc = "\n".join(reversed(above))
                out.append((first, child.end_lineno or first, kind, child.name, leading_doc(doc)))
            walk(child)

    walk(tree)
    return out


def nodes_of(text: str | None, language: str | None) -> list[tuple[int, int, str, str, str | None]] | None:
    """Nodes of source in a language that can be read, else None."""
    if language == "python":
        return syntax_nodes(text)
    found = brace_nodes(text, language)
    return None if found is None else [(a, b, kind, symbol, leading_doc(doc)) for a, b, kind, symbol, doc in found]


def file_sections(diff: str | None) -> list[tuple[str | None, str]]:
    """(path, text) of the sections of a diff, one for each file."""
    out = []
    for part in re.split(r"(?m)^(?=diff --git )", diff or ""):
        if part.startswith("diff --git "):
            found = re.search(r" b/(.+)$", part.split("\n", 1)[0])
            out.append((found[1] if found else None, part))
    return out


_NODE = "id long, start_line int, end_line int, node_kind string, symbol_name string, leading_doc string, text string"


def window_rows(lines: list[str], size: int = WINDOW, overlap: int = OVERLAP, least: int = LEAST) -> Iterator[tuple[int, int]]:
    """(first, last) of the windows over lines, from 1."""
    at = 0
    while len(lines) - at >= least:
        yield at + 1, min(at + size, len(lines))
        if at + size >= len(lines):
            return
        at += size - overlap


def file_chunks(df: DataFrame, id_col: str, text_col: str, language: Column) -> DataFrame:
    """Chunks of files: nodes of source in Python and in languages with braces; of other files, and of
    source without nodes or that can't be read, windows of lines."""

    def rows(key: int, text: str | None, lang: str | None) -> Iterator[tuple]:
        if not text or not text.strip():
            return
        lines = re.sub(r"\n\Z", "", text).split("\n")
        nodes = nodes_of(text, lang)
        for first, last, kind, symbol, doc in nodes or ():
            yield key, first, last, kind, symbol, doc, "\n".join(lines[first - 1 : last])
        if not nodes:
            for first, last in window_rows(lines):
                yield key, first, last, None, None, None, "\n".join(lines[first - 1 : last])

    return per_row(df.select(F.col(id_col).cast("long"), F.col(text_col), language), rows, _NODE)


def diff_chunks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Chunks of diffs: of hunks of source the deepest node that has added lines which say something,
    each node once; of other hunks, and where no node claims a line, blocks of added lines."""

    def claimed(after: str, start: int, added: list[int], language: str | None) -> list[tuple]:
        nodes = nodes_of(after, language) or []
        lines = after.split("\n")
        wanted = [n - start + 1 for n in added if lines[n - start].strip() not in ("", "pass", "}", "{", ")", "(")]
        kept = {}
        for line in wanted:
            inside = [n for n in nodes if n[0] <= line <= n[1]]
            if inside:
                deepest = min(inside, key=lambda n: n[1] - n[0])
                kept[deepest[:2]] = deepest
        return [kept[k] for k in sorted(kept)]

    def rows(key: int, text: str | None) -> Iterator[tuple]:
        for path, _, begin, after, added in hunks_of(text):
            if not added:
                continue
            lines = after.split("\n")
            nodes = claimed(after, begin, added, of_name(path.rpartition("/")[2]))
            for first, last, kind, symbol, doc in nodes:
                yield key, path, begin + first - 1, begin + last - 1, kind, symbol, doc, "\n".join(lines[first - 1 : last])
            if not nodes:
                run: list[int] = []
                for n in [*added, None]:
                    if run and (n is None or n != run[-1] + 1 or len(run) == WINDOW):
                        if len(run) >= LEAST:
                            yield key, path, run[0], run[-1], None, None, None, "\n".join(lines[k - begin] for k in run)
                        run = []
                    if n is not None:
                        run.append(n)

    return per_row(df.select(F.col(id_col).cast("long"), F.col(text_col)), rows, "id long, path string, start_line int, end_line int, node_kind string, symbol_name string, leading_doc string, text string")


def pull_summary(title: Column, body: Column, body_max: int = BODY_MAX) -> Column:
    """Title and the begin of the body, parted by a blank line; null if both are blank."""
    t, b = strip(F.coalesce(title, F.lit(""))), strip(F.substring(F.coalesce(body, F.lit("")), 1, body_max))
    return F.when((t != "") & (b != ""), F.concat(t, F.lit("\n\n"), b)).when(t != "", t).when(b != "", b)


def commit_message(text: Column, least: int = MESSAGE_MIN) -> Column:
    """A message without white space around it; null under ``least`` characters."""
    return F.when(~is_blank(text) & (F.char_length(strip(text)) >= least), strip(text))


def note_windows(text: str | None, max_chars: int = NOTE_MAX) -> list[str]:
    """Windows of at most ``max_chars`` characters: paragraphs are packed while they fit, and one that
    is longer by itself is cut hard."""
    text = (text or "").strip("\n")
    if len(text) <= max_chars:
        return [text] if text else []
    packed: list[str] = []
    for paragraph in re.split(r"\n\s*\n", text):
        if packed and packed[-1] and len(packed[-1]) + 2 + len(paragraph) <= max_chars:
            packed[-1] += "\n\n" + paragraph
        elif packed and not packed[-1]:
            packed[-1] = paragraph
        else:
            packed.append(paragraph)
    return [piece[i : i + max_chars] for piece in packed for i in range(0, len(piece), max_chars)]


def note_chunks(df: DataFrame, id_col: str, text_col: str, max_chars: int = NOTE_MAX) -> DataFrame:
    """id, number (from 1) and text of the windows of notes."""

    def rows(key: int, text: str | None) -> Iterator[tuple]:
        for k, window in enumerate(note_windows(text, max_chars), 1):
            yield key, k, window

    return per_row(df.select(F.col(id_col).cast("long"), F.col(text_col)), rows, "id long, number int, text string")
