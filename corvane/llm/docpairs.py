"""Problem 4: functions and methods paired with their documentation.

Texts are lexed (see lexer) and their tokens exploded into rows; the rest is SQL over these rows.
Gaps and islands make comments of the lines of comments; lag windows over the rows without
decorators and attributes attach the comment directly above a definition; lead windows over logical
lines (rows at bracket depth 0, by a cumulative sum) attach docstrings. Where a function ends is told
by islands too: each row that closes brackets (by layout: that stands at a lesser or the same indent)
is put to the levels that it closes, and in the window of a level the next row after a definition is
the one that ends it.

Documentation is real when LEAST_WORDS words remain without the symbol's own words, parameter
tags, directives and notices of generated files. Defined results: null and empty texts have no
functions; of two definitions of one symbol in a text each is a pair, told apart by its line. A
definition without a body ends in its own line, one that nothing closes at the end of the text."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.llm.arrow import flat_map
from corvane.llm.lexer import LAYOUT, language_of, lines

LEAST_WORDS = 5
#: Kinds of nodes that are a single function or method.
SINGLE = ("function_definition", "decorated_definition", "function_declaration", "generator_function_declaration", "method_declaration", "method_definition", "function_item", "variable_declarator", "lexical_declaration", "arrow_function", "function_expression")
#: Lines that speak to tools, and notices of generated or copied files.
DIRECTIVE = (
    r"(?im)^.*(?:\bnoqa\b|\bnolint\b|\bnosec\b|eslint-|tslint:|jshint|prettier-ignore|pylint:|mypy:|flake8|pyright:|type:\s*ignore|pragma:|fmt:\s*(?:off|on|skip)|isort:|yapf:|@ts-|ts-ignore|istanbul ignore|c8 ignore|webpack\w*:|go:\w+|\+build|clippy::|rustfmt|coverage:|-\*- .* -\*-|vim:|SPDX-License|sourceMappingURL|^\s*!/|#region|#endregion|@license|copyright \(c\)|all rights reserved"
    r"|code generated|@generated|auto-?generated|automatically generated|maschinell erzeugt|do not (?:edit|modify)|edits are lost|changes will be overwritten|produced by \S+ v?\d|vendored copy of|imported verbatim|copied unchanged|bundled, see upstream|do not patch here|modify by hand).*$"
)
#: Parameter tags with the names and types they speak of.
TAG = r"(?m)[@\\]\w+(?:[ \t]*\{[^}]*\})?(?:[ \t]+\[?[\w.$]+\]?(?=[ \t]*(?:-|$|@|[\r\n])))?|:\w+(?:[ \t]+[\w.\[\]]+){0,3}:|(?<![\w:])\w+:(?=\s|$)|^[ \t]*[\w*]+[ \t]*\([\w\[\], ]+\)[ \t]*:"


def tokens(df: DataFrame, id_col: str, text_col: str, language: Column | None = None) -> DataFrame:
    """Rows of tokens: id, line, kind, indent, delta, symbol, text and layout (whether functions end by
    their indent); see lexer.lines. Of the inner lines of a string the last is kept."""

    def rows(key: int, text: str | None, lang: str | None) -> Iterator[tuple]:
        layout, held = bool(text) and language_of(lang, text) in LAYOUT, None
        for number, kind, indent, delta, symbol, said in lines(text, lang):
            if kind == "inner" and not delta:
                held = (key, number, kind, indent, 0, None, None, layout)
                continue
            if held:
                yield held
                held = None
            yield key, number, kind, indent, delta, symbol, said, layout
        if held:
            yield held

    lang = language if language is not None else F.lit(None).cast("string")
    return flat_map(df.select(F.col(id_col).cast("long"), F.col(text_col), lang), rows, "id long, line int, kind string, indent int, delta int, symbol string, text string, layout boolean")


def _deep(rows: DataFrame) -> DataFrame:
    """``rows`` with depth (of brackets before the line), nested and logical (a statement begins)."""
    order = W.partitionBy("id").orderBy("line")
    rows = rows.withColumn("depth", F.coalesce(F.sum("delta").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("nested", F.col("depth") > F.least(F.lit(0), F.coalesce(F.min("depth").over(order), F.lit(0))))
    return rows.withColumn("logical", ~F.col("kind").isin("comment", "blank", "inner") & ~F.col("nested"))


def _ends(rows: DataFrame) -> DataFrame:
    """``rows`` with ``end``: for a definition the line where it ends, null if nothing closes it."""
    order = W.partitionBy("id").orderBy("line")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    is_def = F.col("kind").isin("def", "whole")
    rows = rows.withColumns({"was": F.last(F.when(F.col("logical"), F.col("indent")), True).over(before), "kept": F.last(F.when(~F.col("kind").isin("comment", "blank"), F.col("line")), True).over(before)})
    by_indent = F.when(F.col("logical"), F.sequence("indent", F.greatest(F.coalesce("was", F.col("indent")), F.col("indent"))))
    by_depth = F.when(F.col("delta") < 0, F.sequence(F.col("depth") + F.col("delta"), F.col("depth") - 1))
    closed = F.coalesce(F.when(F.col("layout"), by_indent).otherwise(by_depth), F.array())
    own = F.array(F.struct(F.when(is_def, F.when(F.col("layout"), F.col("indent")).otherwise(F.col("depth"))).cast("long").alias("level"), F.lit(1).alias("role")))
    roles = F.concat(F.transform(closed, lambda level: F.struct(level.cast("long").alias("level"), F.lit(0).alias("role"))), own)
    spread = rows.withColumn("_r", F.explode(roles)).select("*", F.col("_r.level").alias("level"), F.col("_r.role").alias("role"))
    level = W.partitionBy("id", "level").orderBy("line", "role")
    spread = spread.withColumns({"next_role": F.lead("role").over(level), "next_line": F.lead("line").over(level), "next_kept": F.lead("kept").over(level)})
    end = F.when(F.col("kind") == "whole", F.col("line")).when(F.col("layout"), F.when(F.col("next_role").isNotNull(), F.greatest("line", "next_kept"))).when(F.col("next_role") == 0, F.col("next_line")).when(F.col("next_role") == 1, F.col("line"))
    return spread.filter("role = 1").withColumn("end", F.when(is_def, end)).drop("was", "kept", "level", "role", "next_role", "next_line", "next_kept")


def definitions(rows: DataFrame, ends: bool = False) -> DataFrame:
    """One row for each definition: id, line, symbol, indent, depth, comment (directly above),
    docstring, in_class (a class or impl begins before it in the text), number (from 1) and, with
    ``ends``, the line ``end`` where it ends (null: at the end of the text)."""
    order = W.partitionBy("id").orderBy("line")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rows = _deep(rows)
    rows = _ends(rows) if ends else rows.withColumn("end", F.lit(None).cast("int"))
    rows = rows.withColumn("kind", F.when(F.col("kind") == "whole", F.lit("def")).otherwise(F.col("kind")))
    comment = F.col("kind") == "comment"
    begins = F.when(comment & ((F.lag("kind").over(order) != "comment") | (F.lag("kind").over(order).isNull())), 1).otherwise(0)
    rows = rows.withColumn("island", F.sum(begins).over(order))
    island = W.partitionBy("id", "island").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("said", F.when(comment, F.array_join(F.collect_list(F.when(comment, F.col("text"))).over(island), "\n")))
    rows = rows.withColumn("in_class", F.coalesce(F.max(F.col("kind") == "class").over(before), F.lit(False)))
    rows = rows.filter("kind <> 'attr' and kind <> 'inner'").withColumns({"above": F.lag("said").over(order), "above_kind": F.lag("kind").over(order)})
    logical = rows.filter("kind = 'def' or logical or kind = 'doc'")
    logical = logical.withColumns({"next_kind": F.lead("kind").over(order), "next_text": F.lead("text").over(order), "next_indent": F.lead("indent").over(order)})
    is_doc = (F.col("next_kind") == "doc") & (F.col("next_indent") > F.col("indent"))
    defs = logical.filter("kind = 'def'").withColumn("number", F.row_number().over(order))
    return defs.select("id", "line", "symbol", "indent", "depth", "in_class", "number", F.when(F.col("above_kind") == "comment", F.col("above")).alias("comment"), F.coalesce("text", F.when(is_doc, F.col("next_text"))).alias("docstring"), "end")


def real_words(doc: Column, symbol: Column) -> Column:
    """The words of ``doc`` that count."""
    text = F.regexp_replace(F.regexp_replace(doc, DIRECTIVE, " "), TAG, " ")
    own = F.transform(F.regexp_extract_all(symbol, F.lit(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_]+"), F.lit(0)), F.lower)
    return F.filter(F.regexp_extract_all(text, F.lit(r"\p{L}+"), F.lit(0)), lambda w: ~F.array_contains(own, F.lower(w)) & (F.lower(w) != F.lower(symbol)))


def documented(df: DataFrame, id_col: str, text_col: str, language: Column | None = None, node_kind: Column | None = None, leading_doc: Column | None = None, least: int = LEAST_WORDS, ends: bool = False) -> DataFrame:
    """id, symbol, line, depth, indent, documentation and end (see definitions) of every function with
    a real one. Of docstring, comment and (of a text that is one function) ``leading_doc`` the first
    real counts."""
    defs = definitions(tokens(df, id_col, text_col, language), ends)
    if leading_doc is not None:
        lead = df.select(F.col(id_col).cast("long").alias("id"), leading_doc.alias("leading")).filter((node_kind if node_kind is not None else F.lit("")).isin(*SINGLE) & F.col("leading").isNotNull())
        defs = defs.join(lead, "id", "left")
    else:
        defs = defs.withColumn("leading", F.lit(None).cast("string"))
    defs = defs.withColumn("leading", F.when((F.col("number") == 1) & ~F.col("in_class"), F.col("leading")))
    docs = F.filter(F.array("docstring", "comment", "leading"), lambda d: d.isNotNull())
    real = F.filter(docs, lambda d: F.size(real_words(d, F.col("symbol"))) >= least)
    return defs.withColumn("documentation", F.get(real, F.lit(0))).filter("documentation is not null").select("id", "symbol", "line", "depth", "indent", "documentation", "end")


def pairs(df: DataFrame, id_col: str, text_col: str, found: DataFrame) -> DataFrame:
    """``found`` (see documented, with ``ends``) with the ``code`` of each function: id, symbol, line,
    documentation and code, without blank lines at its end. Only texts that have a pair are moved."""
    base = df.select(F.col(id_col).cast("long").alias("id"), F.split(F.col(text_col), r"\r\n|\r|\n").alias("_lines"))
    size = F.coalesce(F.col("end"), F.size("_lines")) - F.col("line") + 1
    code = F.regexp_replace(F.array_join(F.slice("_lines", F.col("line"), size), "\n"), r"\s+$", "")
    return found.join(base, "id").select("id", "symbol", "line", "documentation", code.alias("code"))
