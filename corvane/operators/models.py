"""What is given from outside: language models and makers of rules, with retries; and the operators
that use them. Everything runs in the workers over Arrow batches."""

from __future__ import annotations

import json
import random
import re
import time
from collections import Counter
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators import cluster
from corvane.operators.chunkers import per_row
from corvane.operators.embed import Embedder, embed_fitting
from corvane.runtime import durable
from corvane.schema import QUOTES


class TextModel(Protocol):
    """Answers a prompt."""

    def say(self, prompt: str) -> str: ...


class RuleMaker(Protocol):
    """Makes a rule of the texts of a cluster; None where they don't belong together."""

    backend_id: str

    def rule(self, texts: list[str]) -> str | None: ...


class Told:
    """A text model that is a function, such as a client of a service."""

    def __init__(self, say: Callable[[str], str]):
        self._say = say

    def say(self, prompt: str) -> str:
        return self._say(prompt)


class FirstLine:
    """A text model without network: the first line of a prompt that isn't blank."""

    def say(self, prompt: str) -> str:
        return next((line.strip() for line in prompt.splitlines() if line.strip()), "")


class Canned:
    """A text model of fixed answers by prompt, with one for all others; for tests and replays."""

    def __init__(self, answers: dict[str, str], otherwise: str = ""):
        self.answers, self.otherwise = answers, otherwise

    def say(self, prompt: str) -> str:
        return self.answers.get(prompt, self.otherwise)


class FirstText:
    """The shortest of the texts, of equals the first; never fails."""

    backend_id = "extractive"

    def rule(self, texts: list[str]) -> str | None:
        return min(texts, key=lambda t: (len(t), texts.index(t))) if texts else None


class CommonWords:
    """The words that most of the texts hold, in order of the first; None where they share fewer than
    ``least``."""

    backend_id = "common-words"

    def __init__(self, least: int = 2, share: float = 0.5):
        self.least, self.share = least, share

    def rule(self, texts: list[str]) -> str | None:
        words = [re.findall(r"[^\W\d_]{3,}", t.lower()) for t in texts]
        held = Counter(w for found in words for w in set(found))
        kept = [w for w in dict.fromkeys(words[0] if words else ()) if held[w] > self.share * len(texts)]
        return " ".join(kept) if len(kept) >= self.least else None


class Asked:
    """A rule that a text model makes: it is asked with numbered texts and answers a JSON object with
    ``rule``, which may stand within other text. No object, or a null rule, is no rule."""

    backend_id = "text-model"

    def __init__(self, model: TextModel, prompt: str = "State the rule that these comments share as {\"rule\": ...}, or null.\n"):
        self.model, self.prompt = model, prompt

    def rule(self, texts: list[str]) -> str | None:
        said = retried(lambda: self.model.say(self.prompt + "\n".join(f"{k}. {t}" for k, t in enumerate(texts, 1))))
        begin, end = said.find("{"), said.rfind("}")
        try:
            found = json.loads(said[begin : end + 1]) if 0 <= begin < end else None
        except ValueError:
            return None
        rule = found.get("rule") if isinstance(found, dict) else None
        return rule if isinstance(rule, str) else None


def retried(call: Callable[[], str], attempts: int = 4, first_wait: float = 0.5, again: Callable[[Exception], bool] = lambda e: True, sleep: Callable[[float], None] = time.sleep) -> str:
    """What ``call`` gives; after an error for which ``again`` holds it is called anew after a time
    that doubles, with up to half of it more by chance. The last error stands."""
    for k in range(attempts):
        try:
            return call()
        except Exception as error:
            if k + 1 == attempts or not again(error):
                raise
            sleep(first_wait * 2**k * (1 + random.random() / 2))
    raise AssertionError


def distilled(points: DataFrame, chunks: DataFrame, artifacts: DataFrame, maker: RuleMaker, target_id: int, kind: str = "rule") -> tuple[DataFrame, DataFrame]:
    """(artifacts, chunks) of the rules of clusters, by external_id, to be upserted: what gives no rule
    is left out, and the same members always give the same external_id. ``points``: scope, chunk_id,
    embedding."""
    members = durable(cluster.clusters(points), "clusters")
    facts = cluster.cluster_facts(members, chunks, artifacts)
    texts = members.join(chunks.select(F.col("id").alias("chunk_id"), "text"), "chunk_id").groupBy("scope", "cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "text"))), lambda s: s["text"]).alias("texts"))

    def rows(external_id: str, texts: list[str | None]):
        try:
            rule = maker.rule([t for t in texts if t])
        except Exception:
            rule = None
        if rule and rule.strip():
            yield external_id, rule.strip()

    said = per_row(facts.join(texts, ["scope", "cluster_id"]).select("external_id", "texts"), rows, "external_id string, rule string")
    made = durable(facts.join(said, "external_id"), "rules")
    meta = F.to_json(F.struct(F.lit(maker.backend_id).alias("backend"), "cluster_size", F.slice("quotes", 1, QUOTES).alias("example_quotes"), "member_chunk_ids", "member_urls", "member_repos", F.lit("clusters").alias("rule_source")))
    context = F.to_json(F.struct("language", F.slice("quotes", 1, QUOTES).alias("examples"), "member_chunk_ids"))
    return (
        made.select(F.lit(target_id).alias("target_id"), F.lit("rule").alias("kind"), "external_id", "language", meta.alias("meta_json")),
        made.select("external_id", F.lit(kind).alias("kind"), F.col("rule").alias("text"), context.alias("context_json"), "language"),
    )


def review_distances(examples: DataFrame, baseline: TextModel, informed: TextModel, model: Embedder) -> DataFrame:
    """chunk_id, baseline and informed: cosine distances of what two models say on a hunk to the true
    comment. An example for which a model or the embedder fails is left out."""
    import numpy as np

    def distance(a: list[float], b: list[float]) -> float:
        x, y = np.array(a), np.array(b)
        norms = float(np.linalg.norm(x) * np.linalg.norm(y))
        return 1.0 if norms == 0 else max(0.0, 1.0 - float(x @ y) / norms)

    def rows(key: int, hunk: str, truth: str):
        try:
            a, b, t = embed_fitting(model, [baseline.say(hunk), informed.say(hunk), truth])
        except Exception:
            return
        yield key, distance(a, t), distance(b, t)

    return per_row(examples.select(F.col("chunk_id").cast("long"), "diff_hunk", "truth_comment"), rows, "chunk_id long, baseline double, informed double")


def cluster_review_comments(chunks: DataFrame, artifacts: DataFrame, vectors: DataFrame, author: str | None = None, repo: str | None = None, language: str | None = None) -> DataFrame:
    """Clusters of review comments of an author, repository or language."""
    return _clustered("review_comment", chunks, artifacts, vectors, author, repo, language)


def cluster_code_chunks(chunks: DataFrame, artifacts: DataFrame, vectors: DataFrame, author: str | None = None, repo: str | None = None, language: str | None = None) -> DataFrame:
    """Clusters of committed code."""
    return _clustered("code", chunks, artifacts, vectors, author, repo, language)


def cluster_members(kind: str, chunks: DataFrame, artifacts: DataFrame, vectors: DataFrame, author: str | None = None, repo: str | None = None, language: str | None = None) -> DataFrame:
    """chunk_id and embedding of chunks of a kind, and of an author, repository or language."""
    from corvane.operators.filters import Filters, candidate_ids

    ids = candidate_ids(chunks, artifacts, Filters(kind=kind, language=language, repo=repo, author=author))
    return vectors.select("chunk_id", "embedding").join(ids, "chunk_id")


def _clustered(kind: str, chunks: DataFrame, artifacts: DataFrame, vectors: DataFrame, author: str | None, repo: str | None, language: str | None) -> DataFrame:
    return cluster.clusters(cluster_members(kind, chunks, artifacts, vectors, author, repo, language).withColumn("scope", F.lit(kind)))
