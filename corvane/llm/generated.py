"""Problem 2: source files that were generated, packed, copied from elsewhere or are data.

Random forests decide. Notices label: comments at a file's head or end by which tools, packers and
copies tell of themselves, and what is known of a file's origin (folders and names by which tools
and copies go, a repository in the URL or the context that isn't the artifact's own, files that are
one literal). The lines of notices are taken out of a text before its features are made: compression
ratio, token entropy, lengths of identifiers and lines, density of comments, digits, blanks and
literals, and the signs of origin. One forest sees all of these, another the looks alone, so that
files without any sign are found; the higher score counts. The forest of looks learns without files
that only their origin labels, since a copy looks like any other, and is fitted twice: the first
finds unlabelled files that look like labelled ones and labelled ones that look like any other, the
second learns without both.

A file is found by the forest's score; a file whose comment says that it isn't written by hand keeps
that label, whatever the forest thinks of its looks (a copied file looks like any other).

The forests are fitted on a bounded sample (``SAMPLE`` rows by a hash of the id); features, labels
and scores are computed once, for all files. Defined results: files without text count by their
origin; null URLs, repositories and contexts tell nothing; configuration files are never found."""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.arrow import flat_map
from corvane.runtime import durable

#: Rows to fit on at most, trees and depth of the forest, score from which on a file is found.
SAMPLE, TREES, DEPTH, SCORE = 20_000, 20, 6, 0.5
#: Places of the hash by which the sample is drawn: so many that a sample of any corpus has some.
PLACES = 1 << 53
#: Languages of configuration and documents.
CONFIG = ("yaml", "toml", "json", "ini", "xml", "markdown", "text", "properties", "dockerfile", "makefile")

_HEADER = re.compile(
    r"@generated\b|<auto-?generated|\bcode generated\b|\b(?:auto|machine|tool)[- ]?(?:matically )?generated\b"
    r"|\b(?:auto-?)?(?:generated|produced|emitted|compiled|transpiled) (?:automatically )?(?:by|from|with|using|via) (?!hand\b)"
    r"|\b(?:maschinell|automatisch) (?:erzeugt|generiert|erstellt)|\bautomatiquement\b.{0,20}\bg[ée]n[ée]r[ée]|\bg[ée]n[ée]r[ée].{0,20}\bautomatiquement|\bgenerado autom"
    r"|\b(?:edits|changes|modifications) (?:\w+ ){0,4}(?:lost|overwritten|discarded|clobbered|reverted)\b|\bdo not (?:edit|modify|change|patch|touch|alter)\b|\bnicht (?:bearbeiten|editieren)\b|\bne pas (?:modifier|[ée]diter)\b|\bno editar\b"
    r"|\b(?:vendored|bundled|imported|copied|mirrored|forked|taken|extracted|backported|synced)(?: copy| verbatim| unchanged| unmodified| as[- ]is)* (?:of|from) |\bmirror of \S+/\S+|\b(?:vendored|bundled|copied|imported|mirrored)\b.{0,40}\bupstream\b|\bupstream:? https?://",
    re.I,
)
_PACKED = re.compile(r"\A\s*/\*!.{0,120}?\bv?\d+\.\d+.{0,80}?\*/", re.S)
#: What a comment quotes is no notice, and what was written by hand has none.
_QUOTED, _HAND = re.compile(r"\"[^\"]*\"|`[^`]*`|“[^”]*”"), re.compile(r"\bhand-?written\b|\bby hand from\b", re.I)
_COMMENT = re.compile(r"^\s*(?:#|//|/\*|\*|<!--|--|;|%)")
_FOLDER = re.compile(
    r"(?:^|/)(?:vendor|third[_-]?party|3rd-?party|node_modules|bower_components|godeps|external|externals|extern|deps|submodules|subprojects|pods|carthage|site-packages|vendored|contrib/upstream-[^/]+|upstream-[^/]+|__generated__|generated|zz_generated|gen|codegen|autogen|generated-sources|generated/sources)/",
    re.I,
)
_NAME = re.compile(r"(?:[._-](?:min|bundle|chunk|pack|prod)\.(?:js|mjs|cjs|css|ts)|\.(?:pb|g|gen|generated|auto|designer)\.\w+|\.pb\.(?:go|cc|h)|_pb2(?:_grpc)?\.pyi?|[_-](?:generated|gen|autogen|bindings)\.\w+|\.d\.ts|^zz_generated[\w.]*)$", re.I)
_IDENT = re.compile(r"[^\W\d]\w*")
_TOKEN = re.compile(r"[^\W\d]\w*|\d+(?:\.\d+)?|[^\s\w]")
_LITERAL = re.compile(r"^\s*(?:[\[({]?\s*(?:[-+]?\d[\d._eExXa-fA-F]*|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|null|true|false)\s*[,;:)\]}+]*\s*)+$|^\s*[\[\](){},;]+\s*$|^[A-Za-z0-9+/=]{40,}$")


def path_of(url: str | None, context_path: str | None) -> str:
    """The path of a file: of its URL without place and parameters, else of its context."""
    m = re.search(r"/(?:blob|raw|tree|src)/[^/]+/([^?#]*)", url or "")
    return (m[1] if m else context_path or "").replace("\\", "/")


def _says(line: str) -> bool:
    """Whether a comment is a notice."""
    return bool(_HEADER.search(_QUOTED.sub(" ", line))) and not _HAND.search(line)


def _edge(lines: list[str]) -> Iterator[str]:
    """The comments that ``lines`` begin with, up to the first code."""
    inside = False
    for line in lines:
        if not inside and line.strip() and not _COMMENT.match(line):
            return
        opened, closed = line.rfind("/*"), line.rfind("*/")
        inside = opened > closed or inside and closed < 0
        yield line


def header_notice(text: str) -> bool:
    """Whether comments at the head or the end of a text, however many there are, say that a tool, a
    packer or another project made it."""
    if _PACKED.match(text):
        return True
    lines = re.split(r"\r\n|\r|\n", text)
    tail = []
    for line in reversed(lines):
        if line.strip() and not _COMMENT.match(line):
            break
        tail.append(line)
    return any(map(_says, _edge(lines))) or any(map(_says, tail))


def path_notice(path: str) -> bool:
    """Whether folders or name are those of tools and copies."""
    name = re.sub(r"_[0-9a-z]{2,4}(?=[._-])", "", path.rpartition("/")[2], count=1)
    return bool(_FOLDER.search(path) or _NAME.search(path.rpartition("/")[2]) or _NAME.search(name))


def _facts(key: int, text: str | None, context: str | None) -> Iterator[tuple]:
    """One row of sums for a piece of a file; sums of pieces are sums of the file."""
    repo = path = None
    try:
        said = json.loads(context or "{}")
        repo, path = (said.get("repo"), said.get("path")) if isinstance(said, dict) else (None, None)
    except ValueError:
        if m := re.search(r'"repo"\s*:\s*"([^"\\]+)"', context or ""):
            repo = m[1]
        if m := re.search(r'"path"\s*:\s*"([^"\\]+)"', context or ""):
            path = m[1]
    text = text or ""
    notice = header_notice(text)
    kept = [x for x in text.splitlines() if not (_HEADER.search(x) or "/*!" in x)]
    body = "\n".join(kept)
    tokens = Counter(_TOKEN.findall(body))
    n = sum(tokens.values())
    entropy = -sum(c / n * math.log2(c / n) for c in tokens.values()) if n else 0.0
    idents = [len(x) for x in _IDENT.findall(body)]
    data = body.encode("utf-8", "surrogatepass")
    filled = [x for x in kept if x.strip()]
    yield (
        key,
        repo if isinstance(repo, str) else None,
        path if isinstance(path, str) else None,
        notice,
        float(len(body)),
        float(len(data)),
        float(len(zlib.compress(data, 6))) if data else 0.0,
        entropy * len(body),
        float(n),
        float(len(idents)),
        float(sum(idents)),
        float(sum(1 for x in idents if x <= 2)),
        float(len(filled)),
        float(sum(1 for x in filled if _COMMENT.match(x))),
        float(max(map(len, filled), default=0)),
        float(sum(c.isdigit() for c in body)),
        float(sum(c.isspace() for c in body)),
        float(sum(1 for x in filled if _LITERAL.match(x))),
        float(sum(c in "\"'" for c in body)),
    )


_SUMS = ("chars", "bytes", "packed", "entropy", "tokens", "idents", "ident_chars", "short_idents", "lines", "comments", "digits", "blanks", "literals", "quotes")
_DDL = "artifact_id long, c_repo string, c_path string, header boolean, chars double, bytes double, packed double, entropy double, tokens double, idents double, ident_chars double, short_idents double, lines double, comments double, widest double, digits double, blanks double, literals double, quotes double"
#: Inputs of the forest.
LOOKS = ("ratio", "token_entropy", "ident_length", "short_share", "comment_share", "line_length", "widest_line", "digit_share", "blank_share", "token_length", "ident_share", "quote_share", "literal_share")
ORIGIN = ("folder", "name", "foreign")


def _share(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)


def _repository(url: str) -> Column:
    """The repository that the URL of a file names; '' if none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^(?:\w+://)?(?:[^/@]*@)?[^/]+/(.+?)/(?:-/)?(?:blob|raw|tree|src)/", 1)), r"\.git$", "")


def features(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row for each row of ``files`` (id, source_url, repo, language): LOOKS and ORIGIN, header
    (a comment is a notice), data (one literal), config, and ``notice`` for any label. ``chunks``:
    artifact_id, text, context_json. Of the texts only sums are shuffled."""
    facts = flat_map(chunks.select(F.col("artifact_id").cast("long"), "text", "context_json"), _facts, _DDL)
    sums = facts.groupBy("artifact_id").agg(*(F.sum(c).alias(c) for c in _SUMS), F.max("widest").alias("widest"), F.max("header").alias("header"), F.min("c_repo").alias("c_repo"), F.max("c_repo").alias("c_repo2"), F.min("c_path").alias("c_path"))
    path_of_file = F.when(F.col("source_url").rlike("/(?:blob|raw|tree|src)/[^/]+/"), F.regexp_extract("source_url", "/(?:blob|raw|tree|src)/[^/]+/([^?#]*)", 1)).otherwise(F.coalesce("c_path", F.lit("")))
    rows = files.select(F.col("id").cast("long").alias("id"), "source_url", "repo", "language").join(sums, F.col("id") == F.col("artifact_id"), "left").fillna(0.0, [*_SUMS, "widest"])
    path = F.regexp_replace(path_of_file, r"\\+", "/")
    name = F.element_at(F.split(path, "/"), -1)
    short = F.regexp_replace(name, "_[0-9a-z]{2,4}(?=[._-])", "")
    own, said = F.lower("repo"), _repository("source_url")
    elsewhere = (said != "") & (said != own) & ~said.endswith(F.concat(F.lit("/"), own))
    flags = {
        "folder": path.rlike(f"(?i){_FOLDER.pattern}"),
        "name": name.rlike(f"(?i){_NAME.pattern}") | short.rlike(f"(?i){_NAME.pattern}"),
        "foreign": F.coalesce(elsewhere, F.lit(False)) | F.coalesce(F.lower("c_repo") != own, F.lit(False)) | F.coalesce(F.lower("c_repo2") != own, F.lit(False)),
        "data": (F.col("lines") >= 8) & (F.col("literals") >= 0.9 * (F.col("lines") - 2)),
        "header": F.coalesce("header", F.lit(False)),
        "config": F.coalesce(F.lower("language").isin(*CONFIG), F.lit(False)) | path.rlike(r"(?i)\.(?:ya?ml|toml|ini|cfg|conf|properties|env|json|md)$"),
    }
    rows = rows.select(
        "id",
        *(c.alias(k) for k, c in flags.items()),
        _share("packed", "bytes").alias("ratio"),
        _share("entropy", "chars").alias("token_entropy"),
        _share("ident_chars", "idents").alias("ident_length"),
        _share("short_idents", "idents").alias("short_share"),
        _share("comments", "lines").alias("comment_share"),
        F.log1p(_share("chars", "lines")).alias("line_length"),
        F.log1p("widest").alias("widest_line"),
        _share("digits", "chars").alias("digit_share"),
        _share("blanks", "chars").alias("blank_share"),
        _share("chars", "tokens").alias("token_length"),
        _share("idents", "tokens").alias("ident_share"),
        _share("quotes", "chars").alias("quote_share"),
        _share("literals", "lines").alias("literal_share"),
        F.col("chars"),
    )
    return rows.withColumn("notice", (F.col("header") | F.col("folder") | F.col("name") | F.col("foreign") | F.col("data")) & ~F.col("config"))


def _score(model, rows: DataFrame, name: str) -> DataFrame:
    scored = model.transform(rows.drop("rawPrediction", "probability", "prediction"))
    return scored.withColumn(name, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def _both(rows: DataFrame) -> bool:
    return rows.select("label").distinct().count() == 2


def judge(rows: DataFrame, sample: int = SAMPLE, seed: int = 7) -> DataFrame:
    """``rows`` of features with ``score`` of the forest and ``found``. Where there are no labels of
    both kinds the notices alone decide."""
    rows = durable(rows, "features")
    inputs = [F.col(c).cast("double").alias(c) for c in (*LOOKS, *ORIGIN)]
    vectors = rows.filter("not config").select("id", F.col("notice").cast("double").alias("label"), (F.col("header") | F.col("name") | F.col("data")).alias("made"), *inputs)
    for name, columns in (("looks", LOOKS), ("all", (*LOOKS, *ORIGIN))):
        vectors = VectorAssembler(inputCols=list(columns), outputCol=name).transform(vectors)
    vectors = vectors.select("id", "label", "made", "looks", "all")
    total = vectors.count()
    place = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(PLACES))
    part = durable(vectors if total <= sample else vectors.filter(place < int(PLACES * sample / total)), "sample")
    forest = lambda column: RandomForestClassifier(featuresCol=column, labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=seed, subsamplingRate=0.8, featureSubsetStrategy="0.5" if column == "all" else "auto")
    scored = None
    if _both(part):
        scored = _score(forest("all").fit(part), vectors, "score")
        seen = part.filter("made or label = 0")
        if _both(seen):
            first = _score(forest("looks").fit(seen), seen, "p")
            clean = first.filter("label = 1 and p >= 0.5 or label = 0 and p < 0.25").drop("p")
            if _both(clean):
                scored = _score(forest("looks").fit(clean), scored, "by_looks").withColumn("score", F.greatest("score", "by_looks"))
        scored = scored.select("id", "score")
    if scored is None:
        return rows.withColumn("score", F.lit(0.0)).withColumn("found", F.col("notice"))
    joined = rows.join(scored, "id", "left").fillna(0.0, ["score"])
    return joined.withColumn("found", ((F.col("score") >= SCORE) | F.col("header")) & ~F.col("config"))
