"""Scalar functions as column expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.schema import AST_HEADERLESS, DECISIONS


def iso_timestamp(text: Column) -> Column:
    """The instant of ISO text; without offset it is UTC, and what is no such text is null."""
    shaped = text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$")
    return F.when(shaped, F.regexp_replace(text, r"Z$", "+00:00").try_cast("timestamp"))


def strip(text: Column) -> Column:
    """Without white space at both ends, line ends and tabs included."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    """Whether a text is null or has nothing but white space."""
    return F.coalesce(strip(text) == "", F.lit(True))


def nul_hash(*parts: Column) -> Column:
    """sha256 of parts joined by NUL; a null part counts as empty."""
    joined: list[Column] = []
    for part in parts:
        joined += [F.lit("\u0000"), F.coalesce(part.cast("string"), F.lit(""))]
    return F.sha2(F.concat(*joined[1:]), 256)


def normalized(text: Column, keep: str = "") -> Column:
    """Lower case; runs of other signs than letters, digits and ``keep`` become one hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), f"[^a-z0-9{keep}]+", "-"), r"^-+|-+$", "")


def rule_slug(text: Column) -> Column:
    """The first 60 signs of the normal form with the first 8 of the text's sha1."""
    base, digest = F.regexp_replace(F.substring(normalized(text), 1, 60), "-+$", ""), F.substring(F.sha1(text), 1, 8)
    return F.when(base == "", digest).otherwise(F.concat(base, F.lit("-"), digest))


def repo_slug(full_name: Column) -> Column:
    """``owner/name`` as ``owner__name``."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(full_name), "/", "__"), "[^a-z0-9_]+", "-"), "^[-_]+|[-_]+$", "")


def profile_slug(login: Column) -> Column:
    """The normal form of a login, never empty."""
    return F.when(normalized(login) == "", "unnamed").otherwise(normalized(login))


def file_page_path(repo: Column, path: Column) -> Column:
    """Where the page of a file stands."""
    return F.concat(F.lit("files/"), repo_slug(repo), F.lit("/"), path, F.lit(".md"))


def compound_parts(token: Column) -> Column:
    """Parts of camel, snake and kebab case in lower case, sorted; none for a single word."""
    spaced = F.regexp_replace(token, r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_")
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(spaced), r"[_\-]+"), lambda p: (p != "") & (p != F.lower(token)))))


def word_tokens(text: Column) -> Column:
    """Runs of ASCII letters, digits and underscores."""
    return F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]+"), F.lit(0))


def age_days(then: Column, now: Column) -> Column:
    """Days between two instants, at least 0; null if one isn't known."""
    days = (F.unix_micros(now) - F.unix_micros(then)) / F.lit(8.64e10)
    return F.when(days < 0, 0.0).otherwise(days)


def noreply_login(email: Column) -> Column:
    """The login within a no-reply address (``number+login@users.noreply...``), else null."""
    login = F.regexp_extract(F.lower(email), r"^(?:\d+\+)?([a-z0-9-]+)@users\.noreply\.", 1)
    return F.when(login != "", login)


def origin_parts(url: Column) -> Column:
    """owner and name of a repository URL, https or ssh; null if it is none."""
    pattern = r"^(?:https?://[^/]+/|ssh://(?:[^@/]+@)?[^/]+/|[^@/\s]+@[^:/]+:)([^/\s]+)/([^/\s]+?)(?:\.git)?/?$"
    owner, name = F.regexp_extract(url, pattern, 1), F.regexp_extract(url, pattern, 2)
    return F.when(owner != "", F.struct(owner.alias("owner"), name.alias("name")))


def pull_number(url: Column) -> Column:
    """The number of the pull request in a URL, else null."""
    found = F.regexp_extract(url, r"/pulls?/(\d+)(?:[/#?]|$)", 1)
    return F.when(found != "", found.cast("long"))


def decision_of(text: Column) -> Column:
    """The decision that free text begins with, else null."""
    first = F.element_at(F.split(F.element_at(F.split(strip(F.lower(F.coalesce(text, F.lit("")))), r"\r?\n"), 1), r"\s+"), 1)
    word = F.regexp_replace(first, r"^[.,:;\"'`*]+|[.,:;\"'`*]+$", "")
    return (
        F.when(word.isin(*DECISIONS), word)
        .when(word.isin("changes", "change", "request_changes", "request"), "changes_requested")
        .when(word == "approve", "approved")
        .when(word == "comment", "commented")
    )


def clean_summary(text: Column) -> Column:
    """The first line that isn't blank, without leaders and quotes, at most 320 signs at a word."""
    line = F.coalesce(F.get(F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), strip), lambda x: x != ""), F.lit(0)), F.lit(""))
    line = F.regexp_replace(line, r"^(?:- )?(?:\* )?(?:• )?(?:1\. )?(?:Description: )?(?:Summary: )?", "")
    line = F.regexp_replace(line, r"(?s)^([\"'`])(.*)\1$", "$2")
    cut = F.regexp_replace(F.substring(line, 1, 320), r" [^ ]*$", "")
    return strip(F.when(F.char_length(line) > 320, F.concat(cut, F.lit("…"))).otherwise(line))


def redact_log(text: Column, literals: tuple[str, ...] = ()) -> Column:
    """Bearer tokens and API-key headers masked, and the given values of 12 signs or more."""
    text = F.regexp_replace(text, r"(?i)bearer\s+[A-Za-z0-9._\-+/=]+", "Bearer ***")
    text = F.regexp_replace(text, r"(?i)(x-api-key[\"']?\s*[:=]\s*[\"']?)[A-Za-z0-9._\-+/=]+", "$1***")
    for value in literals:
        if len(value.strip()) >= 12:
            text = F.replace(text, F.lit(value.strip()), F.lit("***REDACTED***"))
    return text


def json_block(text: Column) -> Column:
    """From the first brace to the last."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def front_matter(text: Column) -> Column:
    """The flat ``key: value`` lines between the fences at the begin, as a map; null without fences."""
    fence = F.regexp_extract(text, r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    lines = F.filter(F.split(fence, r"\r?\n"), lambda x: x.contains(":"))
    entries = F.transform(lines, lambda x: F.struct(strip(F.regexp_extract(x, r"^([^:]*):", 1)).alias("k"), strip(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)).alias("v")))
    return F.when(fence != "", F.map_from_entries(entries))


def markdown_title(text: Column, path: Column) -> Column:
    """The first heading, else the file's name without ending."""
    head = strip(F.regexp_extract(text, r"(?m)^#+[ \t]+(.+)$", 1))
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.when(head != "", head).otherwise(stem)


def human_bytes(n: Column) -> Column:
    """Bytes with a unit, one digit after the point from KB on."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        out = F.when(n >= 1024**power, F.concat(F.format_string("%.1f", n / float(1024**power)), F.lit(f" {unit}"))).otherwise(out)
    return out


def human_duration(seconds: Column) -> Column:
    """Hours, minutes and seconds, leading zeros left out."""
    s = F.floor(seconds).cast("long")
    h, m = F.floor(s / 3600), F.floor((s % 3600) / 60)
    return F.when(s >= 3600, F.concat(h.cast("string"), F.lit("h "), m.cast("string"), F.lit("m"))).when(s >= 60, F.concat(m.cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s"))).otherwise(F.concat(s.cast("string"), F.lit("s")))


def commit_url(host: str, repo: Column, sha: Column) -> Column:
    """The page of a commit."""
    return F.concat(F.lit(f"https://{host}/"), repo, F.lit("/commit/"), sha)


def blob_url(host: str, repo: Column, sha: Column, path: Column) -> Column:
    """The page of a file at a commit."""
    return F.concat(F.lit(f"https://{host}/"), repo, F.lit("/blob/"), sha, F.lit("/"), path)


def discussion_url(host: str, repo: Column, category: Column, title: Column, body: Column) -> Column:
    """The form of a new discussion with category, title and body filled in."""
    field = lambda name, c: F.concat(F.lit(f"{name}="), F.url_encode(c))
    return F.concat(F.lit(f"https://{host}/"), repo, F.lit("/discussions/new?"), field("category", category), F.lit("&"), field("title", title), F.lit("&"), field("body", body))


def formatted_front_matter(meta: Column, body: Column) -> Column:
    """A text with ``key: value`` lines of a map between fences before it; keys in order."""
    lines = F.transform(F.array_sort(F.map_entries(meta)), lambda e: F.concat(e["key"], F.lit(": "), e["value"], F.lit("\n")))
    return F.concat(F.lit("---\n"), F.array_join(lines, ""), F.lit("---\n"), body)


def compact_json(value: Column) -> Column:
    """JSON without blanks, null fields kept; null stays null."""
    return F.when(value.isNotNull(), F.to_json(value, {"ignoreNullFields": "false"}))


def truncated(text: Column, lines: int = 40) -> Column:
    """The first ``lines`` lines and how many more there are."""
    parts = F.split(text, "\n")
    more = F.size(parts) - lines
    return F.when(more > 0, F.concat(F.array_join(F.slice(parts, 1, lines), "\n"), F.lit("\n... [+"), more.cast("string"), F.lit(" more lines]"))).otherwise(text)


def header(kind: Column, context: Column, summary: Column) -> Column:
    """What stands before a chunk's text when it is embedded; '' where nothing does. ``context`` is
    JSON text; a summary counts for code, files and commits only."""
    get = lambda key: F.get_json_object(context, f"$.{key}")
    path, symbol, node, doc = get("path"), get("symbol_name"), get("node_kind"), get("leading_doc")
    has = lambda c: F.coalesce(c != "", F.lit(False))
    line = lambda c: F.when(has(c), F.concat(F.lit("# "), c, F.lit("\n"))).otherwise("")
    ast = F.concat(F.lit("# "), F.when(has(path), path).otherwise("<unknown>"), F.lit(" :: "), symbol, F.lit(" ("), node, F.lit(")\n"), line(summary), line(doc), F.lit("\n"))
    plain = F.when(has(path) | has(summary), F.concat(line(path), line(summary), F.lit("\n"))).otherwise("")
    code = F.when(has(symbol) & has(node), ast).otherwise(plain)
    repo, sha, number = get("repo"), get("commit_sha"), get("pr_number")
    commit = F.when(has(repo) | has(sha), F.concat(F.lit("# commit "), F.when(has(repo), repo).otherwise("?"), F.lit("@"), F.when(has(sha), F.substring(sha, 1, 7)).otherwise("?"), F.lit("\n"), line(summary), F.lit("\n"))).otherwise("")
    parts = F.array_join(F.filter(F.array(F.when(has(repo), repo), F.concat(F.lit("#"), number)), lambda x: x.isNotNull()), " ")
    review = F.when(parts != "", F.concat(F.lit("# review on "), parts, F.when(has(path), F.concat(F.lit(" ("), path, F.lit(")"))).otherwise(""), F.lit("\n\n"))).otherwise("")
    title = F.when(has(get("title")), get("title")).otherwise(path)
    note = F.when(has(title), F.concat(F.lit("# note: "), title, F.lit("\n\n"))).otherwise("")
    return (
        F.when(kind.isin(*AST_HEADERLESS), "")
        .when(kind.isin("code", "code_rule", "file"), code)
        .when(kind == "commit_message", commit)
        .when(kind == "review_comment", review)
        .when(kind == "note", note)
        .otherwise("")
    )


def profile_key(base: Column, language: Column, repo: Column, target: Column) -> Column:
    """The key of a cached profile."""
    say = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat(base, F.lit("|lang="), say(language), F.lit("|repo="), say(repo), F.lit("|target="), say(target))
