"""Problem 7: personal data in free text, found by type and replaced by typed placeholders.

Mail addresses, phone numbers and street addresses have a grammar of their own and are read by it.
Names and identity numbers are found by bootstrapped contextual extraction: seed entities (names
that stand beside an address made of them; numbers of strict form under a telling word) induce
lexical patterns, which are the words to the left and right; Spark scores the graph of patterns and
instances in rounds: a pattern counts by the share of its instances that are known, and the
instances of good patterns become known, with their given and family names. Patterns of high score
then show entities that no seed had. Nothing of the corpus is collected: all tables stay DataFrames.

Defined results: null, empty and blank texts hold nothing. Addresses of mailboxes that nobody reads,
of bots and build machines, logins, and user parts of URLs are no personal data."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.arrow import flat_map
from corvane.runtime import durable

TYPES = ("email", "phone", "id_number", "street_address", "person_name")
#: Least known instances of a good pattern and least share of its instances.
LEAST_KNOWN, LEAST_SHARE = 3, 0.6

_EMAIL = re.compile(r"(?<![\w.+%@/-])(?P<local>[\w.+%'-]*\w)(?P<at>@)(?P<domain>[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,})(?![\w@])|(?<![\w.+-])(?P<slocal>[\w.+-]*\w)\s*(?:\(at\)|\[at\]|\{at\}|<at>|\s[aA][tT]\s|\sAT\s)\s*(?P<sdomain>[\w-]+(?:\s*(?:\(dot\)|\[dot\]|\{dot\}|<dot>|\s[dD][oO][tT]\s|\sDOT\s|\.)\s*[\w-]+)*\s*(?:\(dot\)|\[dot\]|\{dot\}|<dot>|\s[dD][oO][tT]\s|\sDOT\s)\s*[A-Za-z]{2,})(?!\w)")
_ROLE = re.compile(r"(?:no[-_.]?reply|do[-_.]?not[-_.]?reply|git|hg|svn|root|deploy|ci|ci[-_.].*|.*[-_.]ci|.*\[?bot\]?|bot|build(?:s|er|bot)?|jenkins|github|gitlab|runner|daemon|mailer-daemon|postmaster|nobody|none|localhost|ec2-user|ubuntu|www-data|automation|dependabot|renovate|actions|.*runner)$", re.I)
_MACHINE = re.compile(r"(?:^|\.)(?:[\w-]*noreply[\w-]*|no-reply|bots?|builds?|ci|localhost|local|internal|invalid)\.", re.I)
_PHONE = re.compile(
    r"(?<![\w.+:/-])(?:\+\d{1,3}[ .-]?(?:\(0\)[ .-]?)?(?:\(\d{1,4}\)[ .-]?)?\d{1,5}(?:[ .-]?\d{2,5}){1,5}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|(?:1[ .-])?\d{3}([.-])\d{3}\1\d{4}|0\d{2,4} \d{3,4} \d{3,4}|\(0\d{2,4}\) ?\d{3,4} ?\d{3,5}|0\d{2,4}[/-]\d{5,8})(?![\w/:-]|[.,]\d)"
)
_STREET = re.compile(
    r"(?<![\w.])\d{1,5}[A-Za-z]?,? (?:[A-ZÀ-Ž][\w'’.-]+ ){1,4}(?:Street|St|Lane|Ln|Drive|Dr|Avenue|Ave|Road|Rd|Court|Ct|Crescent|Cres|Boulevard|Blvd|Way|Place|Pl|Terrace|Close|Square|Sq|Highway|Hwy|Parkway|Pkwy|Row|Walk|Alley|Mews|Hill|Gardens|Grove|Circle|Cir|Trail|Trl)\b"
    r"|(?<![\w.])\d{1,4}(?: ?(?:bis|ter))?,? (?:rue|avenue|boulevard|bd|av|place|chemin|allée|impasse|quai|route|cours|square|passage|ruelle)\.? (?:(?:de|du|des|la|le|les|l'|l’|d'|d’) ?){0,2}[A-ZÀ-Ž][\w'’-]+(?:[ -][A-ZÀ-Ž][\w'’-]+)*"
    r"|\b[A-ZÀ-Ž][\wäöüß-]*(?:straße|strasse|str\.|gasse|weg|allee|platz|ufer|damm|ring|steig|chaussee|graben|markt|zeile|pfad|stieg)\s+\d{1,4} ?[a-zA-Z]?\b(?![.:-]\d)"
    r"|\b[A-ZÀ-Ž][\wäöüß-]+(?:er|en|s)? (?:Straße|Strasse|Str\.|Gasse|Weg|Allee|Platz|Ufer|Damm|Ring|Chaussee|Markt)\s+\d{1,4} ?[a-zA-Z]?\b(?![.:-]\d)"
    r"|\b(?:Am|An der|An den|Im|In der|In den|Zum|Zur|Auf der|Auf dem|Unter den|Hinter der|Alte|Alter|Neue) (?:[A-ZÄÖÜ][\wäöüß-]+ ){1,2}\d{1,4} ?[a-z]?\b(?![.:-]\d)"
    r"|\b(?:Via|Viale|Corso|Piazza|Calle|Avenida|Plaza|Rua|Ulica|ul\.) (?:(?:de|del|della|di|la|los|las|do|da) )*[A-ZÀ-Ž][\w'’-]+(?: [A-ZÀ-Ž][\w'’-]+)*,? \d{1,4}\b"
)
#: Strict forms of identity numbers, and the words that tell of one.
_ID_FORM = re.compile(r"(?<![\w.-])(?:\d{3}([- ])\d{2}\1\d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[A-Z]{1,2}\d{6,8}|\d{6}/\d{3,4}|[A-Z]{3,6}\d{5,7}[A-Z0-9]{2,6}|\d{9}|\d{2} \d{6} [A-Z] \d{3}|[A-Z0-9]{9,10})(?![\w-]|[.,/]\d)")
_ID_WORD = re.compile(r"\b(?:ssn|social security(?: (?:number|no\.?|#))?|ni number|nino|national insurance(?: number| no\.?)?|passport(?: (?:number|no\.?|nr\.?|#))?|reisepass(?:nummer|-nr\.?)?|(?:national |personal )?(?:id|identity)(?: card)?(?: (?:number|no\.?|card))?|personalausweis(?:nummer|-nr\.?)?|ausweis(?:nummer)?|driv(?:ing|er'?s?)[ -]licen[cs]e(?: (?:number|no\.?))?|führerschein(?:nummer)?|licen[cs]e (?:number|no\.?)|tax id|steuer-?id|insurance (?:number|no\.?)|versicherungsnummer|sozialversicherungsnummer)\s*[:#=]?\s*$", re.I)
_CAP = r"(?:[A-ZÀ-ÖØ-ÞĀ-ĽŁ-Ž][\w'’]*[a-zß-öø-ÿāăąćčďđēęěğģīįķłļńňōőœŕřśşšţťūůűųźżžı](?:-[A-ZÀ-Ž][\w'’]*[a-zß-ž])?|[A-ZÀ-ÖØ-ÞŁŚŠŽ][A-ZÀ-ÖØ-ÞŁŚŠŽ'’-]{2,})"
_PART = r"(?:van|der|den|de|von|zu|la|le|du|di|da|al|el|bin|ibn|ter|ten|O'|Ó|Ní|Mac|VAN|DER|DE|VON)"
_RUN = re.compile(rf"(?<![\w@./#'’-])(?:{_CAP}|(?:[A-Z]\.))(?:(?:,)? (?:{_CAP}|[A-Z]\.|{_PART}(?= )))+(?![\w@])")
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*|[^\s\w]|_")
#: Letters that fill the places of entities while contexts are read.
_FILL = {"email": "Ʃ", "street_address": "Ʒ", "phone": "Ʊ"}
_TITLE = re.compile(r"(?:dr|mr|mrs|ms|prof|herr|frau|mme|sir|madame)\.?$", re.I)


def fold(text: str) -> str:
    """Lower case without accents, as names stand in addresses."""
    text = unicodedata.normalize("NFKD", text.lower().replace("ø", "o").replace("ł", "l").replace("æ", "ae").replace("ß", "ss").replace("đ", "d"))
    return "".join(c for c in text if c.isalnum())


def _before(text: str, at: int) -> str:
    """What stands before ``at`` up to the last blank."""
    begin = at
    while begin and at - begin < 200 and not text[begin - 1].isspace():
        begin -= 1
    return text[begin:at]


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses of people, also spelled out."""
    for m in _EMAIL.finditer(text):
        local = m["local"] or m["slocal"]
        domain = m["domain"] or re.sub(r"\s*(?:[(\[{<]?\bdot\b[)\]}>]?)\s*", ".", m["sdomain"], flags=re.I)
        if _ROLE.match(local) or _MACHINE.search(domain + ".") or "[bot]" in text[m.start() - 12 if m.start() > 12 else 0 : m.end()]:
            continue
        head = _before(text, m.start())
        if "://" in head or re.search(r"\b(?:ssh|scp|rsync|sftp|git clone)\s+(?:-\S+ )*$", text[max(0, m.start() - 24) : m.start()]) or text[m.end() : m.end() + 1] == ":" and re.match(r":[\w~/-]+/", text[m.end() : m.end() + 40]):
            continue
        if m["slocal"] and not re.search(r"[.\w]", local):
            continue
        yield m.start(), m.end()


def phones(text: str) -> Iterator[tuple[int, int]]:
    """Phone numbers, by their grouping and count of digits."""
    for m in _PHONE.finditer(text):
        digits = sum(c.isdigit() for c in m[0])
        if 9 <= digits <= 15 and not re.search(r"(?:version|trace(?: id)?|order|build|issue|seen on|port|checksum|#)\s*$", text[max(0, m.start() - 16) : m.start()], re.I):
            yield m.start(), m.end()


def streets(text: str) -> Iterator[tuple[int, int]]:
    """Streets with a house number."""
    for m in _STREET.finditer(text):
        yield m.start(), m.end()


def _sign(word: str) -> str:
    return word[0] if word[0] in _FILL.values() else re.sub(r"\d+", "9", word.lower())


def _context(text: str, begin: int, end: int) -> tuple[str, str, str]:
    """Patterns of a place: two words to the left; one to the left and one to the right; the two
    words to the right. Digits count as one sign, a line's end as a word, and what stands for an
    entity found before (see _FILL) as one of its type."""
    line = text.rfind("\n", 0, begin) + 1
    stop = text.find("\n", end)
    left = [_sign(w) for w in _WORD.findall(text, max(line, begin - 48), begin)]
    left = ["^", "^", *left][-2:]
    right = [_sign(w) for w in _WORD.findall(text, end, min(end + 48, len(text) if stop < 0 else stop))]
    right = [*right, "$", "$"][:2]
    return f"L {left[0]} {left[1]}", f"M {left[1]} _ {right[0]}", f"R {right[0]} {right[1]}"


def names(text: str) -> Iterator[tuple[int, int, str, str, bool]]:
    """Candidates for names: (begin, end, given, family, seed). Every stretch of two to four words
    of a run of capitalised words is one; a seed stands beside an address that is made of it, and what
    overlaps it is none."""
    for run in _RUN.finditer(text):
        parts = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\s,]+", text[run.start() : run.end()])]
        comma = {e for _, e, _ in parts if text[run.start() + e : run.start() + e + 1] == ","}
        found = []
        full = [k for k, (_, _, w) in enumerate(parts) if len(w.rstrip(".")) > 1 and not re.fullmatch(_PART, w) and not _TITLE.match(w)]
        for i, k in enumerate(full):
            for last in full[i + 1 : i + 4]:
                words = parts[k : last + 1]
                if len([x for x in full if k <= x <= last]) > 3 or len(words) > 5:
                    break
                inner = [e for _, e, _ in words[:-1] if e in comma]
                if inner and (len(words) != 2):
                    break
                core = [fold(w) for _, _, w in words if len(w.rstrip(".")) > 1 or w in ("Ó",)]
                given, family = (core[-1], core[0]) if inner else (core[0], "".join(core[1:]))
                begin, end = run.start() + words[0][0], run.start() + words[-1][1]
                near = text[end : end + 80]
                m = re.match(r"\s*[<(\[;,]?\s*(?:mail=|mailto:)?([\w.+-]+)@", near)
                seed = bool(m and family and (local := fold(re.sub(r"\d+$|\+.*", "", m[1]))) and (given in local and (family in local or fold(words[-1][2]) in local)))
                found.append((begin, end, given, family, seed))
        sure = [x for x in found if x[4]]
        yield from sure or found


def numbers(text: str) -> Iterator[tuple[int, int, bool]]:
    """Candidates for identity numbers: (begin, end, seed). A seed stands after a telling word."""
    for m in _ID_FORM.finditer(text):
        if sum(c.isdigit() for c in m[0]) >= 5:
            yield m.start(), m.end(), bool(_ID_WORD.search(text, max(0, m.start() - 48), m.start()))


def _rows(place: str):
    def rows(key: int, text: str | None) -> Iterator[tuple]:
        if not text or text.isspace():
            return
        taken, signs = bytearray(len(text)), list(text)
        for kind, find in (("email", emails), ("street_address", streets), ("phone", phones)):
            if kind != "email" and not any(c.isdigit() for c in text):
                continue
            for a, b in find(text):
                taken[a:b] = b"\x01" * (b - a)
                signs[a:b] = _FILL[kind] * (b - a)
                yield place, key, kind, a, b, None, None, None, None, None, True
        filled = "".join(signs)
        for a, b, seed in numbers(text):
            if not any(taken[a:b]):
                yield place, key, "id_number", a, b, text[a:b], "", *_context(filled, a, b), seed
        for a, b, given, family, seed in names(text):
            if family and not all(taken[a:b]):
                yield place, key, "person_name", a, b, given, family, *_context(filled, a, b), seed

    return rows


_DDL = "place string, row_id long, pii_type string, begin int, end int, e1 string, e2 string, p1 string, p2 string, p3 string, seed boolean"


def candidates(df: DataFrame, id_col: str, text_col: str, place: str) -> DataFrame:
    """Entities of the texts of ``df`` that stand by their grammar (p1 is null) and candidates with
    their entity (e1, e2), patterns (p1, p2, p3) and whether they are seeds."""
    return flat_map(df.select(F.col(id_col).cast("long"), F.col(text_col)).filter(F.col(text_col).isNotNull()), _rows(place), _DDL)


def bootstrap(found: DataFrame, rounds: int | None = None, least_known: int = LEAST_KNOWN, least_share: float = LEAST_SHARE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(patterns, firsts, seconds): good patterns by type, and the first and second parts of known
    entities (given and family names; for numbers the number and ''). Rounds go on until no entity is
    new, or for ``rounds`` at most. What is known only grows, so there is a last one."""
    graph = found.filter("p1 is not null").select("pii_type", "e1", "e2", F.explode(F.array("p1", "p2", "p3")).alias("pattern")).distinct()
    graph = durable(graph, "graph")
    known = durable(found.filter("p1 is not null and seed").select("pii_type", "e1", "e2").distinct(), "known")
    patterns, size, done = None, -1, 0
    while (rounds is None or done < rounds) and (n := known.count()) > size:
        size, done = n, done + 1
        firsts, seconds = (durable(known.groupBy("pii_type", e).agg(F.count("*").alias("_n")).select("pii_type", e), e) for e in ("e1", "e2"))
        sure = graph.join(firsts.withColumn("_f", F.lit(1)), ["pii_type", "e1"], "left").join(seconds.withColumn("_s", F.lit(1)), ["pii_type", "e2"], "left")
        scored = sure.groupBy("pii_type", "pattern").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col("_f") * F.col("_s"), F.lit(0))).alias("k"))
        patterns = durable(scored.filter((F.col("k") >= least_known) & (F.col("k") >= least_share * F.col("n"))).select("pii_type", "pattern"), "patterns")
        reached = graph.join(patterns, ["pii_type", "pattern"]).groupBy("pii_type", "e1", "e2").agg(F.count("*").alias("_n"))
        # A name is known by two patterns at once; one pattern alone shows a place, not an entity.
        known = durable(known.unionByName(reached.filter("_n >= 2").select("pii_type", "e1", "e2")).distinct(), "known")
    firsts, seconds = (known.select("pii_type", e).distinct() for e in ("e1", "e2"))
    return patterns, firsts, seconds


def entities(found: DataFrame, rounds: int | None = None) -> DataFrame:
    """place, row_id, pii_type, begin and end of all personal data among candidates."""
    found = durable(found, "pii")
    patterns, firsts, seconds = bootstrap(found, rounds)
    open_ = found.filter("p1 is not null")
    good = open_.join(firsts.withColumn("_f", F.lit(1)), ["pii_type", "e1"], "left").join(seconds.withColumn("_s", F.lit(1)), ["pii_type", "e2"], "left")
    for k in (1, 2, 3):
        good = good.join(patterns.select("pii_type", F.col("pattern").alias(f"p{k}"), F.lit(1).alias(f"_p{k}")), ["pii_type", f"p{k}"], "left")
    by_name = (F.col("_f") == 1) & (F.col("_s") == 1)
    by_pattern = sum((F.coalesce(F.col(f"_p{k}"), F.lit(0)) for k in (1, 2, 3)), F.lit(0)) >= 2
    good = good.filter(F.col("seed") | by_name | by_pattern)
    columns = ["place", "row_id", "pii_type", "begin", "end"]
    return found.filter("p1 is null").select(columns).unionByName(good.select(columns))


def mask(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """``text`` with each span replaced by its type in brackets; of spans that overlap the first
    and longest counts."""
    if text is None:
        return None
    out, at = [], 0
    for a, b, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
    return "".join(out) + text[at:]


def redact(df: DataFrame, id_col: str, text_col: str, spans: DataFrame) -> DataFrame:
    """row_id and masked text of every row of ``df``; ``spans`` as entities gives them."""
    held = spans.groupBy("row_id").agg(F.collect_list(F.struct("begin", "end", "pii_type")).alias("_spans"))
    base = df.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("_text")).join(held, "row_id", "left")

    def rows(key: int, text: str | None, found: list[dict] | None) -> Iterator[tuple]:
        yield key, mask(text, [(s["begin"], s["end"], s["pii_type"]) for s in found or ()]), len(found or ())

    return flat_map(base.select("row_id", "_text", "_spans"), rows, "row_id long, masked string, n_found int")
