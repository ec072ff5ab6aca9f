"""Problem 5: live credentials in code, configuration, prose and URLs, found and masked.

A text is read by a set of recognisers (key blocks, vendor tokens, user parts and parameters of
URLs, headers, assignments, command lines, notes in prose). Each is left out where the words that
it cannot do without are absent (GUARDS). Literals that decode as base64, hex, percent signs or
backslash escapes are decoded and read again, layer by layer until nothing decodes any more (each
layer is shorter than the one around it); what is found in a layer masks the enclosing literal as a
whole. Containers of keys are read by their binary grammar (DER: PKCS#8, also encrypted, PKCS#1,
SEC1, DSA; OpenSSH), in blocks with BEGIN lines, in literals without them, and in decoded bytes. A
block that holds a public key or a certificate is none; one that is no container at all (encrypted
in the old form, cut off or altered) counts when its body is as random as a key.

Defined results: null and empty texts hold nothing. Spans are in characters of the text; lines
count from 1 and end at a line feed. Masking keeps all but the values, so quotes, separators and
line ends stay as they are."""

from __future__ import annotations

import base64
import binascii
import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from urllib.parse import unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.arrow import flat_map

#: What stands in place of a value, and bits of a character that a key's body has at least.
MASK, KEY_ENTROPY = "[REDACTED]", 4.0

#: Names that hold a credential, as the last words of an identifier.
_NAME = (
    r"(?:[\w.-]*[_.-])?(?:pass(?:word|wd|phrase|code)?|pwd|secret|secret[_-]?key|secret[_-]?access[_-]?key|(?:access|api|auth|encryption|private|signing|client|webhook|service|master|account|storage|shared|session|deploy|x[_-]?api)[_-]?(?:key|secret|token|pass|password)"
    r"|access[_-]?key[_-]?id|token|auth|credentials?|apikey|_?authtoken|auth[_-]?header|authorization|bearer|dsn|connection[_-]?string|pgpassword|(?:admin|db|user|root|smtp|mail|ftp)[_-]?pass(?:word|wd)?)"
    r"|\w*(?-i:Password|Passwd|Passphrase|Pass|Pwd|Secret|Token|ApiKey|AccessKey|SecretKey|PrivateKey|SigningKey|EncryptionKey|Credential)|(?-i:[A-Z_]*)(?-i:PASS|PASSWORD|PASSWD|SECRET|TOKEN|API_KEY|SECRET_KEY|ACCESS_KEY|PRIVATE_KEY)"
)
_STR = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\\n]|\\.)*`"
_ASSIGN = re.compile(rf"(?P<q>[\"']?)(?<![\w.])(?P<name>{_NAME})(?P=q)(?:\s*:\s*[\w<>&']+)?\s*(?::=|=>|=(?!=)|:(?!:))\s*(?P<open>[\[(]\s*)?(?P<value>{_STR}|[^\s\"'`,;)\]}}>#]+)", re.I)
_FOLDED = re.compile(rf"^[ \t]*[\"']?(?P<name>{_NAME})[\"']?\s*:\s*[>|][-+]?[ \t]*\r?\n(?P<value>(?:[ \t]+\S+[ \t]*(?:\r?\n|$))+)", re.I | re.M)
_MORE = re.compile(rf"\s*(?:[+,.]\s*)?(?P<value>{_STR})")
_BLOCK = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?)-----")
_BODY_LINE = re.compile(r"[\s\"'`#*>|,+;()]*(?:[A-Za-z0-9+/=]|\\[nr])*[\s\"'`\\,+;()]*|[\s#*>|]*[\w-]+: [^\n]*")
_VENDOR = re.compile(
    r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{40,}|glpat-[\w-]{20,}|xox[abprs]-[\w-]{20,}|AIza[\w-]{30,}|npm_[A-Za-z0-9]{30,}|pypi-[\w-]{30,}"
    r"|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}|[a-z]{2,8}[_.-](?:live|prod|test|pat|sk|secret|key|token|api)[_.-][A-Za-z0-9]{20,}|(?:sk|pk|rk)[_-](?:live|prod)[_-][A-Za-z0-9]{16,}|sk-[A-Za-z0-9]{32,})(?![A-Za-z0-9])"
)
_URL = re.compile(r"\b[a-z][a-z0-9+.-]{1,20}://(?P<user>[^\s/:@\"'`<>?#]*)(?::(?P<pass>[^\s/@\"'`<>?#]*(?:%40)?[^\s/@\"'`<>?#]*))?@(?=[\w\[])", re.I)
_PARAM = re.compile(r"[?&;](?:private_token|access_token|auth_token|token|api_?key|apikey|key|secret|client_secret|password|passwd|pwd|sig|signature|x-amz-signature|auth)=(?P<value>[^\s&#\"'`<>;]+)", re.I)
_HEADER = re.compile(r"(?P<name>[\"']?(?:proxy-)?authorization[\"']?\s*[:=]\s*[\"']?)(?:(?P<kind>basic|bearer|token|apikey)\s+)?(?P<value>[A-Za-z0-9+/_=.~-]{8,})|\bbearer\s+(?P<bearer>[A-Za-z0-9+/_=.~-]{16,})|\bbasic\s+(?P<basic>[A-Za-z0-9+/]{12,}={0,2})|[\"']?x-[\w-]*(?:token|key|secret|auth)[\"']?\s*:\s*[\"']?(?P<x>[^\s\"',;}]{8,})", re.I)
_KEYWORD = re.compile(r"(?:;|^|[\"'])\s*(?:pwd|password|accountkey|sharedaccesskey|secret)\s*=\s*(?P<value>[^;\"'\s]+)(?=[;\"'\s]|$)", re.I | re.M)
_COMMAND = re.compile(r"\bsshpass\s+-p\s*(?P<a>'[^']+'|\"[^\"]+\"|\S+)|\bcurl\b[^\n]*?\s(?:-u|--user)\s+(?P<c>'[^']+'|\"[^\"]+\"|\S+)|\bmachine\s+\S+\s+login\s+\S+\s+password\s+(?P<n>\S+)|\b(?:mysql|psql|mysqldump)\b[^\n]*?\s(?:-p|--password=)(?P<m>'[^']+'|\"[^\"]+\"|[^\s'\"-]\S+)")
_NPM = re.compile(r":_(?:authToken|auth|password)=(?P<value>[^\s\"']+)")
_PROSE = re.compile(r"\b(?:password|passwd|pwd|pw|passphrase|pass|secret|token|api key|access key|credentials?)\b(?:\s+for\s+[\w.-]+|\s+of\s+[\w.-]+)?\s*(?:is|was|:|=|->|are)?\s*(?P<q>[\"'`]?)(?P<value>[^\s\"'`(){}]{6,})(?P=q)|\blog ?in\b[^\n]{0,40}?\b(?:is|as|with|:)\s+\S+\s*(?:/|with|and)\s*(?P<login>\S{6,})", re.I)
#: Words of which a text must hold one (in folded case) for a recogniser to find anything in it; they
#: follow from the patterns above. A tuple within is a set of words that are needed together.
_NAMES = ("pass", "pwd", "secret", "key", "token", "auth", "credential", "bearer", "dsn", "connection")
GUARDS = {
    "block": ("private key",),
    "url": (("://", "@"),),
    "param": (("?", "="), ("&", "="), (";", "=")),
    "header": ("authorization", "bearer", "basic", "x-"),
    "keyword": (("=", "pwd"), ("=", "password"), ("=", "accountkey"), ("=", "sharedaccesskey"), ("=", "secret")),
    "command": ("sshpass", "curl", "machine", "mysql", "psql"),
    "npm": (":_",),
    "assign": tuple((name, sign) for name in _NAMES for sign in ("=", ":")),
    "folded": tuple((name, sign) for name in _NAMES for sign in ("|", ">")),
    "prose": ("pass", "pwd", "pw", "secret", "token", "api key", "access key", "credential", "login", "log in"),
}
_WORDS = sorted({w for ways in GUARDS.values() for way in ways for w in ([way] if isinstance(way, str) else way)})
_RUN = re.compile(r"[\w-]{20}|eyJ")
_LITERAL = re.compile(r"(?<![A-Za-z0-9+/=_%\\-])(?:(?P<b64>[A-Za-z0-9+/_-]{20,}={0,2})|(?P<pct>[\w.~-]*(?:%[0-9A-Fa-f]{2}[\w.~-]*){6,})|(?P<esc>(?:[^\s\"'\\]*\\(?:x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4})){6,}[^\s\"'\\]*))(?![A-Za-z0-9+/=])")
_HEX = re.compile(r"(?:[0-9a-fA-F]{2}){12,}")
_UUID = re.compile(r"[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}", re.I)
_PLACEHOLDER = re.compile(
    r"[*x.•#-]{3,}$|<.*>$|\$|\{\{|%\(|%[A-Z_]+%$|\[.*\]$|(?:your|my|the|some|insert|enter|replace|put|add|change|todo|fixme|dummy|sample|example|placeholder|redacted|masked|removed|hidden|none|null|nil|undefined|true|false|test|fake|foo|bar|baz|secret|password|passwd|token|xxx)(?:[ _\-.]?(?:your|my|me|here|key|token|secret|password|passwd|value|api|it|this|in|prod|default|please|string|with|real|one|\d{1,3}))*[>!]*$"
    r"|(?:your|my|replace|insert|change|enter)[-_ ]",
    re.I,
)
_REFERENCE = re.compile(r"^(?:os\.|process\.|env\b|env\.|ENV\b|config\b|settings?\b|self\.|this\.|vault|secrets?\.|getenv|get_?secret|viper|import\.|ssm|keyring|var\.|local\.|data\.|await\b|new\b|function\b|async\b)|[\w.]+[(\[{]|^[a-z_]\w*(?:\.\w+)+$|^&|^@", re.I)
_NOT_SECRET = re.compile(r"(?:count|label|hint|prompt|length|len|size|type|name|field|limit|policy|regex|pattern|url|uri|path|file|expir\w*|ttl|index|id|ids|max\w*|min\w*|text|title|page|public|hash|hashed|digest|checksum|sha\d*|md5|icon|commit)", re.I)
_LAST_WORD = re.compile(r"[A-Z]?[a-z]+$|[A-Z]+$|\d+$")
_PUBLIC = re.compile(r"^(?:ssh-(?:rsa|ed25519|dss)|ecdsa-|sha(?:1|256|384|512)-|data:)", re.I)


def entropy(value: str) -> float:
    """Bits of a character of ``value``, by how often each occurs in it."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def placeholder(value: str) -> bool:
    """Whether a value stands for one: empty, masked, told to be filled in, or a reference."""
    value = value.strip()
    return len(set(value)) < 4 or bool(_PLACEHOLDER.match(value) or "${" in value or "{{" in value or "<" in value and ">" in value)


def random_like(value: str) -> bool:
    """A value that a machine made: long, with letters and digits, of high entropy."""
    return len(value) >= 16 and not re.search(r"\s", value) and bool(re.search(r"\d", value)) and bool(re.search(r"[A-Za-z]", value)) and entropy(value) >= 3.0


def password_like(value: str) -> bool:
    """A value that a person would type: letters and digits, no blank, not one plain word."""
    return len(value) >= 8 and not re.search(r"\s", value) and bool(re.search(r"[A-Za-z]", value)) and bool(re.search(r"\d", value)) and (bool(re.search(r"[A-Z]", value) and re.search(r"[^\w]|_", value)) or entropy(value) >= 3.0)


def live(value: str) -> bool:
    """Whether a value under a telling name would grant access."""
    return not placeholder(value) and not _UUID.fullmatch(value) and not _PUBLIC.match(value) and not re.fullmatch(r"[\d.,:-]+", value) and (random_like(value) or password_like(value))


def container(body: str) -> str:
    """What a key block's body is by its binary grammar: private, public (or a certificate), opaque
    (of no container, but as random as a key), or '' for anything else."""
    text = re.sub(r"\s+|\\[nr]|^[\w-]+:.*$", "", body, flags=re.M)
    text = re.sub(r"[^A-Za-z0-9+/=]", "", text)
    if len(text) < 40:
        return ""
    try:
        data = base64.b64decode(text.rstrip("=") + "=" * (-len(text.rstrip("=")) % 4))
    except (binascii.Error, ValueError):
        data = b""
    if private_container(data):
        return "private"
    whole = _der(data) if data[:1] == b"\x30" else None
    if whole and len(whole) == 1 and whole[0][0] == 0x30 and _der(whole[0][1]):
        return "public"
    return "opaque" if entropy(text) >= KEY_ENTROPY else ""


def _der(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tags and contents of the DER elements that ``data`` is made of, or None if it is no DER."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 0 < n <= 4 or at + n > len(data):
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if at + size > len(data):
            return None
        out.append((tag, data[at : at + size]))
        at += size
    return out


def private_container(data: bytes) -> bool:
    """Whether bytes are the container of a private key: OpenSSH's, or DER as PKCS#8 (also encrypted),
    PKCS#1, DSA or SEC1. Public keys and certificates are none."""
    if data.startswith(b"openssh-key-v1\0"):
        return True
    whole = _der(data) if data[:1] == b"\x30" else None
    if not whole or len(whole) != 1 or not (inner := _der(whole[0][1])):
        return False
    tags, first = [t for t, _ in inner], inner[0][1]
    if tags[:3] == [2, 0x30, 4]:
        return first in (b"\0", b"\1")
    if tags[:2] == [2, 4]:
        return first == b"\1" and len(inner[1][1]) >= 16
    if tags == [0x30, 4]:
        return first.startswith((b"\x06\x09\x2a\x86\x48\x86\xf7\x0d\x01\x05", b"\x06\x0a\x2a\x86\x48\x86\xf7\x0d\x01\x0c\x01"))
    return len(tags) >= 6 and set(tags[:6]) == {2} and first in (b"\0", b"\1")


def key_literal(value: str) -> bool:
    """Whether a base64 or hex literal is the container of a private key."""
    if len(value) < 40 or not value.startswith(("M", "b3BlbnNzaC1rZXkt", "30", "6f70656e", "6F70656E")):
        return False
    try:
        if _HEX.fullmatch(value):
            return private_container(bytes.fromhex(value))
        value = value.rstrip("=").translate({45: 43, 95: 47})
        return private_container(base64.b64decode(value + "=" * (-len(value) % 4), validate=True))
    except (binascii.Error, ValueError):
        return False


def _body_end(text: str, at: int) -> int:
    """Where the lines end that may be of a key's body which no END line closes."""
    while True:
        stop = text.find("\n", at)
        line = text[at : stop if stop >= 0 else len(text)]
        if not _BODY_LINE.fullmatch(line):
            return at
        if stop < 0:
            return len(text)
        at = stop + 1


def _blocks(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _BLOCK.finditer(text):
        end = text.find(f"-----END {m[1]}-----", m.end())
        body = text[m.end() : end if end >= 0 else _body_end(text, m.end())]
        if (kind := container(body)) in ("private", "opaque") and "..." not in body[:80]:
            yield m.start(), m.end() + len(body) + (len(m[1]) + 14 if end >= 0 else 0), f"private key ({kind})"


def _bare(m: re.Match, group: str) -> tuple[int, int, str]:
    a, b = m.span(group)
    value = m[group]
    if len(value) > 1 and value[0] in "\"'`" and value[-1] == value[0]:
        return a + 1, b - 1, value[1:-1]
    return a, b, value


def _assignments(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _ASSIGN.finditer(text):
        name = m["name"]
        if text[max(0, m.start() - 2) : m.start()] == "//":
            continue
        if (word := _LAST_WORD.search(name)) and _NOT_SECRET.fullmatch(word[0]) and not re.search(r"access[_-]?key[_-]?id$", name, re.I):
            continue
        a, b, value = _bare(m, "value")
        quoted = a > m.start("value")
        if not quoted and (_REFERENCE.search(value) or text[b : b + 1] in "([{."):
            continue
        if not quoted and re.fullmatch(r"[A-Za-z_][A-Za-z_]*", value):
            continue
        spans, whole, at = [(a, b)], value, m.end()
        while quoted and (more := _MORE.match(text, at)):
            joint = text[at : more.start("value")]
            if "," in joint and not m["open"]:
                break
            c, d, piece = _bare(more, "value")
            if "." in joint:
                break
            spans.append((c, d))
            whole, at = whole + piece, more.end()
        if _URL.search(value) or re.search(r"\bPwd=|\bpassword=", value, re.I) or re.match(r"(?:bearer|basic)\s", value, re.I) or value.startswith("-----"):
            continue
        if live(whole) or key_literal(whole):
            for c, d in spans:
                yield c, d, "assignment" if c == a else "continued"


def _folded(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _FOLDED.finditer(text):
        pieces = list(re.finditer(r"\S+", m["value"]))
        if live("".join(p[0] for p in pieces)):
            for p in pieces:
                yield m.start("value") + p.start(), m.start("value") + p.end(), "assignment" if p is pieces[0] else "continued"


def _vendor(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _VENDOR.finditer(text):
        if not placeholder(m[0]) and entropy(m[0]) > 2.5:
            yield m.start(), m.end(), "vendor token"


def _urls(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _URL.finditer(text):
        user, word = m["user"] or "", m["pass"]
        if word is not None and not placeholder(unquote(word)) and not _REFERENCE.search(word) and (len(word) >= 6 and re.search(r"\d|[^\w]", word) or random_like(word)):
            yield m.start("pass"), m.end("pass"), "URL password"
        elif word in (None, "", "x-oauth-basic") and random_like(user) and re.search(r"[0-9a-f]{32,}|[A-Za-z0-9_-]{20,}", user):
            yield m.start("user"), m.end("user"), "URL token"


def _params(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _PARAM.finditer(text):
        if live(unquote(m["value"])):
            yield m.start("value"), m.end("value"), "URL parameter"


def _headers(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _HEADER.finditer(text):
        for group in ("value", "bearer", "basic", "x"):
            if (value := m[group]) is None:
                continue
            if (group == "basic" or (m["kind"] or "").lower() == "basic") and (inner := _base64(value)) is not None:
                if ":" in inner and not placeholder(inner.partition(":")[2]):
                    yield m.start(group), m.end(group), "basic header"
            elif random_like(value) and not placeholder(value) and not _REFERENCE.search(value + " "):
                yield m.start(group), m.end(group), "header"


def _keywords(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _KEYWORD.finditer(text):
        if password_like(m["value"]) and not placeholder(m["value"]):
            yield m.start("value"), m.end("value"), "connection string"


def _commands(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _COMMAND.finditer(text):
        for group in "acnm":
            if m[group]:
                a, b, value = _bare(m, group)
                if group == "c":
                    if ":" not in value:
                        continue
                    a, value = a + value.index(":") + 1, value.partition(":")[2]
                if password_like(value) and not placeholder(value):
                    yield a, b, "command"


def _registry(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _NPM.finditer(text):
        if live(m["value"]):
            yield m.start("value"), m.end("value"), "registry token"


def _prose(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _PROSE.finditer(text):
        group = "value" if m["value"] else "login"
        value = m[group].rstrip(".,;:)")
        if password_like(value) and re.search(r"[A-Z]", value) and not re.search(r"[=({\[<>]|://|^\w+\.\w+\.", value) and not placeholder(value) and not _UUID.fullmatch(value):
            yield m.start(group), m.start(group) + len(value), "prose"


_RECOGNISERS = (("block", _blocks), ("url", _urls), ("param", _params), ("header", _headers), ("keyword", _keywords), ("command", _commands), ("npm", _registry), ("assign", _assignments), ("folded", _folded), ("prose", _prose))


def _plain(text: str, guarded: bool = True) -> Iterator[tuple[int, int, str]]:
    """Spans of values that the recognisers see in ``text`` as it stands."""
    low = text.casefold()
    held = {w for w in _WORDS if w in low} if guarded else set(_WORDS)
    if not guarded or _RUN.search(text):
        yield from _vendor(text)
    for name, recogniser in _RECOGNISERS:
        if any(way in held if isinstance(way, str) else all(w in held for w in way) for way in GUARDS[name]):
            yield from recogniser(text)


def _printable(data: bytes) -> str | None:
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return text if len(text) > 5 and all(c.isprintable() or c in "\r\n\t" for c in text) else None


def _base64(value: str) -> str | None:
    try:
        return _printable(base64.b64decode(value.rstrip("=").translate({45: 43, 95: 47}) + "=" * (-len(value.rstrip("=")) % 4), validate=True))
    except (binascii.Error, ValueError):
        return None


def _decoded(m: re.Match) -> Iterator[str | bytes]:
    """What a literal decodes to: texts, and bytes that are no text."""
    value = m[0]
    if m["b64"]:
        if _HEX.fullmatch(value):
            data = bytes.fromhex(value)
            yield _printable(data) or data
        try:
            bare = value.rstrip("=").translate({45: 43, 95: 47})
            data = base64.b64decode(bare + "=" * (-len(bare) % 4), validate=True)
        except (binascii.Error, ValueError):
            return
        yield _printable(data) or data
    elif m["pct"]:
        if (inner := unquote(value)) != value:
            yield inner
    else:
        try:
            yield json.loads('"' + re.sub(r"\\x", r"\\u00", value) + '"')
        except ValueError:
            return


def _holds(m: re.Match) -> bool:
    """Whether a literal holds a credential in some layer. Each layer is shorter than the last."""
    open_ = list(_decoded(m))
    while open_:
        inner = open_.pop()
        if isinstance(inner, bytes):
            if private_container(inner):
                return True
        elif next(_plain(inner), None):
            return True
        else:
            open_ += [x for m in _LITERAL.finditer(inner) for x in _decoded(m)]
    return False


def find(text: str | None, guarded: bool = True) -> list[tuple[int, int, str]]:
    """Spans (begin, end, kind) of the credentials of a text, in order, none within another."""
    if not text:
        return []
    spans = list(_plain(text, guarded))
    spans += [(m.start(), m.end(), "encoded") for m in _LITERAL.finditer(text) if _holds(m)]
    spans.sort(key=lambda s: (s[0], -s[1]))
    out: list[tuple[int, int, str]] = []
    for a, b, kind in spans:
        if b > a and (not out or a >= out[-1][1]):
            out.append((a, b, kind))
    return out


def mask(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """``text`` with each span masked. Of key blocks the lines stay and their characters go."""
    if text is None:
        return None
    out, at = [], 0
    for a, b, kind in spans:
        out.append(text[at:a])
        if kind.startswith("private key"):
            lines = text[a:b].split("\n")
            inner = [re.sub(r"[A-Za-z0-9+/=]{8,}", MASK, x) if "PRIVATE KEY" not in x else x for x in lines]
            out.append("\n".join(inner))
        else:
            out.append(MASK)
        at = b
    return "".join(out) + text[at:]


def scan(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row_id, line_no, begin, end and kind of each credential in the texts of ``df``. Of a value
    that is put together from several literals the later ones have the kind ``continued``."""

    def rows(key: int, text: str | None) -> Iterator[tuple]:
        for a, b, kind in find(text):
            yield key, text.count("\n", 0, a) + 1, a, b, kind

    return flat_map(df.select(F.col(id_col).cast("long"), F.col(text_col)), rows, "row_id long, line_no long, begin int, end int, kind string")


def redact(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row_id, masked text and number of credentials, for every row of ``df``."""

    def rows(key: int, text: str | None) -> Iterator[tuple]:
        spans = find(text)
        yield key, mask(text, spans), len(spans)

    return flat_map(df.select(F.col(id_col).cast("long"), F.col(text_col)), rows, "row_id long, masked string, n_found int")
