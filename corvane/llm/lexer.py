"""A lexer for source text that gives one token for each line: what the line is, its indent, how it
changes the depth of brackets, and the name of the definition that begins in it. Strings and
comments are told from code first, so nothing within them counts.

Languages with definitions of their own: those of _DEF and the script languages of _JS. A text in
another language, or in none that is named, is read as the first one whose definitions it seems to
hold, else as script."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Comment signs and strings of families of languages.
_PY = re.compile(r"(?P<c>#[^\r\n]*)|(?P<s>[rbfuRBFU]{0,2}(?:\"\"\"(?:[^\\]|\\[\s\S])*?(?:\"\"\"|\Z)|'''(?:[^\\]|\\[\s\S])*?(?:'''|\Z)|\"(?:[^\"\\\r\n]|\\[\s\S])*\"?|'(?:[^'\\\r\n]|\\[\s\S])*'?))")
_C = re.compile(r"(?P<c>//[^\r\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<s>\"(?:[^\"\\\r\n]|\\[\s\S])*\"?|'(?:[^'\\\r\n]|\\[\s\S])*'?|`(?:[^`\\]|\\[\s\S])*(?:`|\Z))")
_RUST = re.compile(r"(?P<c>//[^\r\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<s>b?r(?P<h>#*)\"[\s\S]*?(?:\"(?P=h)|\Z)|b?\"(?:[^\"\\]|\\[\s\S])*(?:\"|\Z)|b?'(?:[^'\\\r\n]|\\[^\r\n]{1,8}?)')")
_SCALA = re.compile(r"(?P<c>//[^\r\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<s>\"\"\"[\s\S]*?(?:\"\"\"|\Z)|\"(?:[^\"\\\r\n]|\\[\s\S])*\"?|'(?:[^'\\\r\n]|\\[^\r\n]{1,5}?)')")
_FAMILY = {"python": _PY, "shell": _PY, "ruby": _PY, "yaml": _PY, "toml": _PY, "rust": _RUST, "scala": _SCALA, "kotlin": _SCALA, "swift": _SCALA}
#: Languages whose definitions end by their indent.
LAYOUT = ("python", "ruby")
_NO = r"(?!(?:if|for|while|switch|catch|return|new|else|throw|do|try|synchronized|sizeof|using|lock|foreach|case|delete)\b)"
_TYPED = re.compile(
    rf"\s*(?:(?:public|private|protected|internal|static|final|abstract|synchronized|native|default|virtual|override|async|inline|extern|constexpr|explicit|friend|unsafe|partial|sealed|const|unsigned|signed|struct|enum)\s+)*"
    rf"(?:<[^>]*>\s*)?{_NO}(?:[\w$:]+(?:<[^()]*>)?(?:\s*\[\])*[\s*&]+)?{_NO}(?:[\w$]+::)*(?P<n>~?[^\W\d][\w$]*)\s*\((?:[^()]|\([^()]*\))*(?:\)\s*(?:const\b|noexcept\b|override\b|final\b|throws\s+[\w., ]+|where\s+[^{{]+)*\s*(?:\{{.*|=>.*)?)?$"
)
_DEF = {
    "python": re.compile(r"\s*(?:async\s+)?def\s+(?P<n>[^\W\d]\w*)"),
    "go": re.compile(r"\s*func\s*(?:\([^)]*\)\s*)?(?P<n>[^\W\d]\w*)\s*[\[(]"),
    "rust": re.compile(r"\s*(?:pub(?:\s*\([^)]*\))?\s+)?(?:(?:default|const|async|unsafe|extern(?:\s+\S+)?)\s+)*fn\s+(?P<n>[^\W\d]\w*)"),
    "scala": re.compile(r"\s*(?:(?:override|private|protected|final|implicit|inline|lazy|abstract|sealed)(?:\[\w+\])?\s+)*def\s+(?P<n>[^\W\d][\w$]*|`[^`]+`)"),
    "kotlin": re.compile(r"\s*(?:(?:public|private|protected|internal|override|open|abstract|final|inline|suspend|operator|infix|tailrec|external)\s+)*fun\s+(?:<[^>]*>\s*)?(?:[\w<>?]+\.)?(?P<n>[^\W\d]\w*)\s*\("),
    "swift": re.compile(r"\s*(?:@\w+\s+)*(?:(?:public|private|fileprivate|internal|open|static|class|final|override|mutating|convenience|required)\s+)*(?:func\s+(?P<n>[^\W\d]\w*)|(?P<m>init)\s*[?(])"),
    "php": re.compile(r"\s*(?:(?:public|private|protected|static|final|abstract)\s+)*function\s+&?(?P<n>[^\W\d]\w*)\s*\("),
    "ruby": re.compile(r"\s*def\s+(?:self\.)?(?P<n>[^\W\d]\w*[?!=]?)"),
    "java": _TYPED,
    "c": _TYPED,
    "cpp": _TYPED,
    "csharp": _TYPED,
    "shell": re.compile(r"\s*(?:function\s+(?P<n>[\w-]+)|(?P<m>[\w-]+)\s*\(\))\s*(?:\(\))?\s*\{?"),
}
_JS = re.compile(
    r"\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:async\s+)?function\s*\*?\s*(?P<n>[^\W\d][\w$]*)"
    r"|\s*(?:export\s+)?(?:const|let|var)\s+(?P<v>[^\W\d][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s+)?(?:function\b|\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::\s*[^=]+)?=>|[^\W\d][\w$]*\s*=>|(?:<[^>]*>)?\($)"
    r"|\s*(?:(?:public|private|protected|static|async|get|set|readonly|override|abstract)\s+)*(?:\*\s*)?#?(?P<m>(?!(?:if|for|while|switch|catch|with|return|function|await|new|typeof|super|else|do|throw|delete|void|yield|import|require)\b)[^\W\d][\w$]*)\s*(?:<[^>]*>)?\((?:[^()]|\([^()]*\))*\)\s*(?::\s*[^{;=]+)?\{\s*\}?\s*$"
)
_CLASS = re.compile(r"\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:pub(?:\s*\([^)]*\))?\s+)?(?:unsafe\s+)?(?:class|impl|interface|trait|struct|enum|mod|namespace|type)\b")
_OPEN, _CLOSE = re.compile(r"[(\[{]"), re.compile(r"[)\]}]")
_LINES = re.compile(r"\r\n|\r|\n")
_MARK = re.compile(r"^[ \t]*(?:/\*+!?|\*+/|\*(?!/)|//[/!]?|#+!?)|\*+/[ \t]*$")


def language_of(language: str | None, text: str) -> str:
    """The language to lex ``text`` as: the one given, else by the first definition that fits."""
    name = (language or "").strip().lower()
    if name in _DEF or name in ("javascript", "typescript", "jsx", "tsx", "yaml", "toml"):
        return name
    for guess, sign in (("python", r"(?m)^\s*(?:async )?def \w+\(.*:?\s*$"), ("go", r"(?m)^func "), ("rust", r"(?m)^\s*(?:pub )?fn "), ("typescript", r"(?m)^\s*(?:export )?(?:async )?(?:function|const) ")):
        if re.search(sign, text):
            return guess
    return name or "text"


def plain(comment: str) -> str:
    """A line of a comment without its signs."""
    return _MARK.sub("", _MARK.sub("", comment)).strip()


def unquoted(literal: str) -> str:
    """What stands within the quotes of a string."""
    return re.sub(r"^[rbfuRBFU]{0,2}(?:\"\"\"|'''|[\"'`])|(?:\"\"\"|'''|[\"'`])$", "", literal).strip()


def whole(bare: str) -> bool:
    """Whether a definition that begins in a line also ends in it: by its braces or a semicolon."""
    code = bare.rstrip()
    opens, closes = len(_OPEN.findall(code)), len(_CLOSE.findall(code))
    return opens == closes and (code.endswith((";", "}", "};", "},")) or bool(re.search(r"=>?\s*[^{(\s][^{]*$|\{[^{}]*\}\s*$", code)))


def lines(text: str | None, language: str | None) -> Iterator[tuple[int, str, int, int, str | None, str | None]]:
    """(line, kind, indent, depth change, symbol, text) of each line, from 1. Kinds: blank, comment,
    attr (decorators and attributes), def, class, doc (a string that is a statement; its text
    stands in the first line, the others are inner), inner and code; ``whole`` is a def that ends in
    its own line. The text of a def is a string that stands as its whole body in the same line."""
    if not text:
        return
    lang = language_of(language, text)
    family = _FAMILY.get(lang, _C)
    if family is not _PY:
        end = text.find("*/")
        if 0 <= end and not 0 <= text.find("/*") < end and not 0 <= text.find("//") < end:
            text = "/*" + text[2:] if end >= 2 else text  # the text begins within a comment
    bounds, at = [], 0
    for m in _LINES.finditer(text):
        bounds.append((at, m.start()))
        at = m.end()
    bounds.append((at, len(text)))
    code, comments, strings = [], [], []
    at = 0
    for m in family.finditer(text):
        code.append(text[at : m.start()])
        if m["c"] is not None:
            comments.append((m.start(), m.end()))
            code.append(re.sub(r"[^\r\n]", " ", m[0]))
        else:
            strings.append((m.start(), m.end()))
            code.append('"' + re.sub(r"[^\r\n]", "_", m[0][1:-1]) + ('"' if len(m[0]) > 1 else ""))
        at = m.end()
    code = "".join(code) + text[at:]
    pattern = _DEF.get(lang, _JS)
    ci = si = 0
    attr_depth = 0
    for number, (a, b) in enumerate(bounds, 1):
        bare = code[a:b]
        stripped = bare.strip()
        indent = len(bare.expandtabs(4)) - len(bare.lstrip().expandtabs(4)) if stripped else 0
        delta = len(_OPEN.findall(bare)) - len(_CLOSE.findall(bare))
        while ci < len(comments) and comments[ci][1] <= a:
            ci += 1
        while si < len(strings) and strings[si][1] <= a:
            si += 1
        within = si < len(strings) and strings[si][0] < a
        if attr_depth > 0:
            attr_depth += delta
            yield number, "attr", indent, delta, None, None
        elif not stripped:
            held = ci < len(comments) and comments[ci][0] < b and comments[ci][1] > a
            yield number, "comment" if held else "blank", 0, 0, None, plain(text[a:b]) if held else None
        elif within and strings[si][1] >= b:
            yield number, "inner", indent, 0, None, None
        elif stripped[0] == "@" and lang != "go" or stripped.startswith(("#[", "#![")) and lang == "rust":
            attr_depth = max(0, delta)
            yield number, "attr", indent, delta, None, None
        elif not within and (m := pattern.match(bare)):
            inline = None
            if lang == "python" and (tail := re.search(r":\s*(?=[rbfuRBFU]{0,2}\"_*\"\s*$)", bare)) and si < len(strings):
                inline = next((unquoted(text[x:y]) for x, y in strings[si:] if x >= a + tail.start() and x < b), None)
            yield number, "whole" if lang not in LAYOUT and whole(bare) else "def", indent, delta, next(v for v in m.groupdict().values() if v).strip("`"), inline
        elif not within and _CLASS.match(bare):
            yield number, "class", indent, delta, None, None
        elif lang == "python" and not within and si < len(strings) and code[a : strings[si][0]].strip() == "" and strings[si][0] < b and re.fullmatch(r"[rbfuRBFU]{0,2}\"[_\s]*\"?;?", code[a : min(b, strings[si][1])].strip()):
            yield number, "doc", indent, delta, None, unquoted(text[strings[si][0] : strings[si][1]])
        else:
            yield number, "code", indent, delta, None, None
