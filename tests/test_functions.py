import fnmatch
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.functions import expand, scalars
from corvane.functions.porter import stem
from corvane.operators.filters import glob_regex


@given(st.text(alphabet="ab/*?.[]!-x\n", max_size=8), st.text(alphabet="ab/.x-\n", max_size=8))
@settings(max_examples=400, deadline=None)
def test_globs_match_as_in_a_shell(glob, text):
    try:
        pattern = re.compile(glob_regex(glob).replace("$", r"\Z"))
    except re.error:
        return  # ranges the other way round
    assert bool(pattern.match(text)) == fnmatch.fnmatchcase(text, glob)


@pytest.mark.parametrize("word,form", [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("conditional", "condit"), ("formalize", "formal"), ("adjustment", "adjust"), ("probate", "probat"), ("controlling", "control"), ("is", "is"), ("user_id", "user_id"), ("", "")])
def test_stems(word, form):
    assert stem(word) == form


def test_expansion_is_stable_and_takes_the_first_group():
    assert expand.RuleExpander().expand("store getUser_id") == [["store", "engine", "index", "indexer"], ["getUser_id", "get", "id", "user"]]
    assert expand.RuleExpander().expand("") == [] and expand.RuleExpander().expand(None) == []
    failing = expand.CompositeExpander(lambda w: 1 / 0)
    assert failing.expand("retry") == [["retry", "backoff", "redrive"]]
    assert expand.CompositeExpander(lambda w: ["Again", "retry"]).expand("retry") == [["retry", "backoff", "redrive", "Again"]]


def test_match_expressions():
    assert expand.match_plain('say "hi"') == '"say" """hi"""'
    assert expand.match_plain("  ") == '""'
    assert expand.match_groups([["a", "A", "b"], [], ["c", " "]]) == '("a" OR "b") AND ("c")'
    assert expand.match_groups([]) == '""'


def _one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


def test_summaries_are_cleaned(spark):
    clean = lambda t: _one(spark, scalars.clean_summary(F.col("t")), t=t)
    assert clean("\n\n- \"Reads files.\"\nmore") == "Reads files."
    assert clean(None) in ("", None) and clean("") == ""
    long = clean("word " * 100)
    assert len(long) <= 321 and long.endswith("word…")


def test_decisions_titles_and_paths(spark):
    d = lambda t: _one(spark, scalars.decision_of(F.col("t")), t=t)
    assert [d(x) for x in ("Approve.", "**changes** please", "comment", "maybe", "", None)] == ["approved", "changes_requested", "commented", None, None, None]
    assert _one(spark, scalars.repo_slug(F.col("t")), t="Owner/My.Repo") == "owner__my-repo"
    assert _one(spark, scalars.markdown_title(F.col("t"), F.lit("a/b.md")), t="text") == "b"
    assert _one(spark, scalars.markdown_title(F.col("t"), F.lit("a/b.md")), t="x\n## Head  \n") == "Head"
    assert _one(spark, scalars.front_matter(F.col("t")), t="---\ngenerated: true\nx: a: b\n---\nbody") == {"generated": "true", "x": "a: b"}
    assert _one(spark, scalars.origin_parts(F.col("t")), t="git@host.example:me/x.git") == ("me", "x")
    assert _one(spark, scalars.origin_parts(F.col("t")), t="no url") is None
    assert _one(spark, scalars.noreply_login(F.col("t")), t="12+Jo-e@users.noreply.git.example") == "jo-e"
    assert _one(spark, scalars.truncated(F.col("t")), t="\n".join("x" * 45)).endswith("\n... [+5 more lines]")


def test_times_are_utc_and_bad_ones_null(spark):
    t = lambda x: _one(spark, F.unix_micros(scalars.iso_timestamp(F.col("t"))), t=x)
    assert t("2026-01-01T00:00:00Z") == t("2026-01-01T02:00:00+02:00") == t("2026-01-01T00:00:00")
    assert t("yesterday") is None and t("") is None and t(None) is None and t("0000-00-00T00:00:00Z") is None


def test_headers(spark):
    h = lambda kind, ctx, s=None: _one(spark, scalars.header(F.lit(kind), F.col("c"), F.col("s")), c=ctx, s=s)
    assert h("file", '{"path":"a.py","symbol_name":"f","node_kind":"function_definition","leading_doc":"Doc."}', "Sum.") == "# a.py :: f (function_definition)\n# Sum.\n# Doc.\n\n"
    assert h("file", '{"path":"a.py"}') == "# a.py\n\n"
    assert h("commit_message", '{"repo":"me/x","commit_sha":"0123456789"}', "S") == "# commit me/x@0123456\n# S\n\n"
    assert h("review_comment", '{"repo":"me/x","pr_number":3,"path":"p"}') == "# review on me/x #3 (p)\n\n"
    assert h("review_comment", "{broken") == "" and h("pr_summary", '{"path":"x"}') == "" and h("note", '{"title":"T"}') == "# note: T\n\n"
