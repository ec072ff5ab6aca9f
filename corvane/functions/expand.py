"""Expansion of query words by rule: synonyms first, then parts of compounds."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Protocol

#: Groups of words that stand for each other. A word that is in several groups has the
#: alternates of the first only.
SYNONYMS = (
    ("function", "func", "fn", "method", "def", "procedure"),
    ("class", "struct", "type", "record", "interface", "trait"),
    ("search", "find", "lookup", "query", "fetch", "get"),
    ("index", "indexer", "store", "engine"),
    ("embed", "embedder", "embedding", "vector", "encode"),
    ("test", "spec", "suite", "expect", "assert"),
    ("error", "err", "fail", "failure", "exception"),
    ("config", "settings", "options", "cfg"),
    ("connect", "connection", "client", "session"),
    ("retry", "backoff", "redrive"),
    ("queue", "channel", "stream", "pipe"),
    ("lock", "mutex", "semaphore", "latch"),
    ("create", "new", "make", "init", "construct"),
    ("delete", "remove", "drop", "destroy", "purge"),
    ("update", "modify", "edit", "patch", "set"),
    ("read", "load", "open", "scan"),
    ("write", "save", "persist", "store"),
    ("start", "begin", "launch", "spawn"),
    ("stop", "halt", "kill", "shutdown", "close"),
    ("parse", "decode", "deserialize"),
    ("serialize", "encode", "marshal"),
)
_GROUP = {word: group for group in reversed(SYNONYMS) for word in group}
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")


def case_variants(token: str) -> list[str]:
    """The token in lower case, and with a capital where it has one case only; each once."""
    found = [token.lower()] + ([token.capitalize()] if token.islower() or token.isupper() else [])
    return [v for v in dict.fromkeys(found) if v != token]


class QueryExpander(Protocol):
    """Turns a query into groups of words, each the word itself and what may stand for it."""

    def expand(self, text: str) -> list[list[str]]: ...


def alternates(token: str) -> list[str]:
    """What may stand for ``token``: synonyms, then parts, each in order of the alphabet."""
    low = token.lower()
    parts = {p.lower() for piece in re.split(r"[_\-]+", token) for p in _HUMP.split(piece) if p}
    words = sorted(set(_GROUP.get(low, ())) - {low}) + sorted(parts - {low})
    return list(dict.fromkeys(words))


class RuleExpander:
    """By rule alone; the same query always gives the same groups."""

    def expand(self, text: str) -> list[list[str]]:
        return [[token, *alternates(token)] for token in re.findall(r"[A-Za-z0-9_]+", text or "")]


class CompositeExpander:
    """A rule's groups with the words that another source adds for each token; what that source
    can't give is left out."""

    def __init__(self, more: Callable[[str], list[str]], rule: QueryExpander | None = None):
        self.more, self.rule = more, rule or RuleExpander()

    def expand(self, text: str) -> list[list[str]]:
        out = []
        for group in self.rule.expand(text):
            try:
                added = self.more(group[0])
            except Exception:
                added = []
            seen, kept = set(), []
            for word in (*group, *added):
                if word and word.lower() not in seen:
                    seen.add(word.lower())
                    kept.append(word)
            out.append(kept)
        return out


def match_plain(text: str) -> str:
    """A keyword expression: each word quoted, all required; no word gives ``""``."""
    return " ".join('"' + t.replace('"', '""') + '"' for t in (text or "").split()) or '""'


def match_groups(groups: list[list[str]]) -> str:
    """A keyword expression of groups: one of each group is required. Words count once whatever
    their case; empty words and groups are left out."""
    said = []
    for group in groups:
        words = list({w.lower(): w for w in reversed(group) if w.strip()}.values())[::-1]
        if words:
            said.append("(" + " OR ".join('"' + w.replace('"', '""') + '"' for w in words) + ")")
    return " AND ".join(said) or '""'
