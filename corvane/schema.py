"""Names and values of the data model."""

from __future__ import annotations

#: Kinds of artifacts and chunks.
ARTIFACT_KINDS = ("commit", "pr", "review_comment", "issue_comment", "file", "rule", "note")
CHUNK_KINDS = ("code", "review_comment", "commit_message", "file", "pr_summary", "rule", "code_rule", "note")
#: Decisions of reviews, in the order that breaks ties.
DECISIONS = ("approved", "changes_requested", "commented")
#: Artifacts that lose weight with age, chunks whose text is embedded without header, and those that
#: get a summary.
DECAYING = ("commit", "pr", "review_comment", "issue_comment")
AST_HEADERLESS = ("pr_summary", "rule")
SUMMARIZABLE = ("code", "file", "code_rule", "commit_message")
#: Constants of retrieval: fusion, candidates of a leg, and how many more are fetched before hits are
#: made one, globs are applied, or filters come after the search.
RRF_K, FETCH, OVER_COALESCE, OVER_GLOB, OVER_SCAN = 60, 50, 3, 4, 8
#: Lines of a snippet, results of a search and of a vote.
SNIPPET_LINES, TOP, TOP_VOTE = 40, 5, 20
#: BM25.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
#: Chunkers: lines of a window, least lines, overlap; characters of a message, body, note and doc.
WINDOW, LEAST, OVERLAP = 80, 3, 10
MESSAGE_MIN, BODY_MAX, NOTE_MAX, DOC_MAX = 20, 2000, 1200, 240
FILE_MAX, AST_MAX = 256 * 1024, 512 * 1024
#: Clusters: least and most members, share of a language that makes it the cluster's, quotes kept.
CLUSTER_MIN, CLUSTER_MAX, LANGUAGE_SHARE, QUOTES = 3, 100, 0.6, 3
#: Pass rates of tiers, and chunk kinds of tools.
TIERS = {1: 1.0, 2: 0.85, 3: 0.70}
TOOL_KINDS = {"find_review_comments": "review_comment", "find_style_examples": "code", "find_code": "file", "find_applicable_rules": "code_rule"}
#: Paths that aren't indexed.
EXCLUDED = ("*.lock", "*package-lock.json", "*yarn.lock", "*Cargo.lock", "*.min.js", "*.min.css", "*.d.ts", "*.bundle.js", "*.bundle.css", "*node_modules*", "vendor/*", "*/vendor/*", "dist/*", "*/dist/*", "build/*", "*/build/*")
#: Version of the text that is embedded; vectors of older versions are made anew.
EMBED_VERSION = 4
