"""Definitions in source with braces, by a parser of declarations.

A text is cut into tokens (words, literals, signs) with its comments left out: nested comments, raw
and interpolated strings, templates with code in them, regular expressions and lifetimes are told from
code. Brackets are matched, and one walk over the tokens asks at each word whether a declaration begins
there, what it is called and where it ends. Kinds of nodes have the names that the public grammars of
tree-sitter give them. What is no declaration is passed over, so broken source still gives those that
are whole; brackets that nothing closes end with the text."""

from __future__ import annotations

import re
from dataclasses import dataclass

from corvane.schema import AST_MAX

#: Literals and comments of all languages but for what nests, which ``_tokens`` reads itself.
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[^\W\d][\w$]*|\$[\w$]*|#(?=[^\W\d])[\w$]+|\d[\w.]*")
_SIGN = re.compile(r"=>|->|<-|::|\.\.\.|===|!==|==|!=|<=|>=|&&|\|\||[^\w\s]")
_LINE = re.compile(r"//[^\n]*")
_QUOTED = {'"': re.compile(r'"(?:[^"\\\n]|\\[\s\S])*"?'), "'": re.compile(r"'(?:[^'\\\n]|\\[\s\S])*'?")}
_RAW = re.compile(r'b?r(#*)"[\s\S]*?(?:"\1|\Z)')
_CHAR = re.compile(r"b?'(?:[^'\\\n]|\\(?:u\{[0-9a-fA-F_]*\}|x[0-9a-fA-F]{2}|[^\n]))'")
_TRIPLE = re.compile(r'"""[\s\S]*?(?:"""+|\Z)')
_REGEX = re.compile(r"/(?![/*])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_BEFORE_REGEX = frozenset("( [ { } , ; : ? = => ! & | && || == === != !== < > <= >= + - * % ^ ~ return typeof case in of void delete throw new else do yield await".split())
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
SCRIPT, TYPED = ("javascript", "jsx", "typescript", "tsx"), ("typescript", "tsx")
LANGUAGES = ("go", "rust", "scala", *SCRIPT)


@dataclass
class Token:
    text: str
    line: int
    literal: bool = False


def _template(text: str, at: int) -> int:
    """The end of a template that begins at ``at``; code within it may hold templates again."""
    i, depth = at + 1, 0
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 2
            continue
        if depth == 0 and c == "`":
            return i + 1
        if depth == 0 and text.startswith("${", i):
            depth, i = 1, i + 2
            continue
        if depth and c == "`":
            i = _template(text, i)
            continue
        if depth and c in "\"'":
            i = _QUOTED[c].match(text, i).end()
            continue
        depth += (c == "{") - (c == "}") if depth else 0
        i += 1
    return len(text)


def _comment(text: str, at: int, nests: bool) -> int:
    """The end of a comment between ``/*`` and ``*/``."""
    if not nests:
        end = text.find("*/", at + 2)
        return len(text) if end < 0 else end + 2
    depth = 0
    for m in re.compile(r"/\*|\*/").finditer(text, at):
        depth += 1 if m[0] == "/*" else -1
        if depth == 0:
            return m.end()
    return len(text)


def tokens_of(text: str, language: str) -> list[Token]:
    """The tokens of a text. A literal is one token that stands for no word."""
    out: list[Token] = []
    at, line = 0, 1

    def take(end: int, literal: bool = True) -> int:
        nonlocal line
        out.append(Token(text[at:end], line, literal))
        line += text.count("\n", at, end)
        return end

    script = language in SCRIPT
    while at < len(text):
        c = text[at]
        if m := _SPACE.match(text, at):
            line += m[0].count("\n")
            at = m.end()
        elif m := _LINE.match(text, at):
            at = m.end()
        elif text.startswith("/*", at):
            end = _comment(text, at, language in ("rust", "scala"))
            line += text.count("\n", at, end)
            at = end
        elif language == "rust" and (m := _RAW.match(text, at) or _CHAR.match(text, at)):
            at = take(m.end())
        elif language == "rust" and c == "'":  # a lifetime
            at = take((re.compile(r"'\w*").match(text, at)).end())
        elif language == "rust" and (m := re.compile(r'b?"(?:[^"\\]|\\[\s\S])*"?').match(text, at)):
            at = take(m.end())
        elif language == "scala" and (m := _TRIPLE.match(text, at)):
            at = take(m.end())
        elif language == "scala" and c == "'" and not _CHAR.match(text, at):
            at = take(at + 1)
        elif c == "`":
            if script:
                at = take(_template(text, at))
            else:
                end = text.find("`", at + 1)
                at = take(len(text) if end < 0 else end + 1, language == "go")
        elif c in _QUOTED:
            at = take(_QUOTED[c].match(text, at).end())
        elif script and c == "/" and (not out or (out[-1].text in _BEFORE_REGEX and not out[-1].literal)) and (m := _REGEX.match(text, at)):
            at = take(m.end())
        elif m := _WORD.match(text, at) or _SIGN.match(text, at):
            at = take(m.end(), False)
        else:
            at += 1
    return out


def matches_of(tokens: list[Token]) -> dict[int, int]:
    """The place of the bracket that closes each open one; the last token where none does."""
    out: dict[int, int] = {}
    open_: list[int] = []
    for i, t in enumerate(tokens):
        if t.literal:
            continue
        if t.text in _OPEN:
            open_.append(i)
        elif t.text in _CLOSE:
            k = next((k for k in range(len(open_) - 1, -1, -1) if _OPEN[tokens[open_[k]].text] == t.text), None)
            if k is not None:
                for lost in open_[k:]:
                    out[lost] = i
                del open_[k:]
    return out | {i: len(tokens) - 1 for i in open_}


class _Walk:
    """One walk over the tokens of a text."""

    def __init__(self, text: str, language: str):
        self.language, self.tokens = language, tokens_of(text, language)
        self.close = matches_of(self.tokens)
        self.open = {end: begin for begin, end in self.close.items()}
        self.indents = [len(x) - len(x.lstrip()) for x in text.split("\n")]
        self.classes: dict[int, int] = {}
        self.out: list[tuple[int, int, str, str]] = []

    def at(self, i: int) -> str:
        """The word or sign at a place; '' for literals and beyond the ends."""
        return self.tokens[i].text if 0 <= i < len(self.tokens) and not self.tokens[i].literal else ""

    def is_name(self, i: int) -> bool:
        return bool(re.fullmatch(r"#?[^\W\d][\w$]*|\$[\w$]*|`[^`]+`", self.at(i)))

    def past(self, i: int) -> int:
        """The place after what stands at ``i``, brackets as a whole."""
        return self.close.get(i, i) + 1

    def generics(self, i: int) -> int:
        """The place after ``<...>``, if that stands at ``i``."""
        if self.at(i) != "<":
            return i
        depth, k = 0, i
        while k < len(self.tokens):
            t = self.at(k)
            if t in _OPEN:
                k = self.past(k)
                continue
            if t in (";", "}", ""):
                if t:
                    return i
            depth += (t == "<") - (t == ">")
            k += 1
            if depth == 0:
                return k
        return i

    def add(self, first: int, end: int, kind: str, name: str) -> None:
        end = min(end, len(self.tokens) - 1)
        self.out.append((self.tokens[first].line, self.tokens[end].line, kind, name.strip("`")))

    def begins(self, i: int, modifiers: frozenset[str]) -> tuple[int, bool]:
        """(the first of the modifiers before ``i``, whether a statement may begin there)."""
        k = i
        while k and (self.at(k - 1) in modifiers or self.at(k - 1) == ")" and self._visibility(k - 1)):
            k = self._visibility(k - 1) - 1 if self.at(k - 1) == ")" else k - 1
        before = self.at(k - 1) if k else ";"
        new_line = k and self.tokens[k].line > self.tokens[k - 1].line
        return k, before in (";", "{", "}", "") or bool(new_line and before not in ("=", "(", ",", ":", "=>", "return", "?", "&", "|", "<", "+"))

    def _visibility(self, i: int) -> int:
        """The place of the bracket of ``pub(...)`` that ends at ``i``, or 0."""
        begin = self.open.get(i, 0)
        return begin if self.at(begin - 1) in ("pub", "private", "protected", "extern") else 0

    def body(self, i: int, type_signs: frozenset[str]) -> int | None:
        """The place of the brace of a body from ``i`` on. A brace that follows a sign of types is
        part of a type; a semicolon ends the search."""
        while i < len(self.tokens):
            t = self.at(i)
            if t == "{":
                if self.at(i - 1) not in type_signs:
                    return i
                i = self.past(i)
            elif t in (";", "}", ")", "]"):
                return None
            else:
                i = self.past(i)
        return None

    def expression(self, i: int) -> int:
        """The last token of an expression from ``i``: up to a semicolon, a closing bracket, or the end
        of a line after which no sign goes on."""
        last = i
        goes_on = ("|", "&", ".", "?", ":", "=>", "&&", "||", "+", "-", "*", "=", "(", "<", ",", "extends", "keyof", "typeof")
        while i < len(self.tokens) and self.at(i) not in (";", ")", "]", "}", ","):
            if i > last and self.tokens[i].line > self.tokens[i - 1].line and self.at(i) not in goes_on[:11] and self.at(i - 1) not in goes_on:
                break
            last = self.close.get(i, i)
            i = last + 1
        return last

    def run(self) -> list[tuple[int, int, str, str]]:
        step = {"go": self.go, "rust": self.rust, "scala": self.scala}.get(self.language, self.script)
        for i in range(len(self.tokens)):
            if not self.tokens[i].literal:
                step(i)
        return self.out

    # Languages

    _SCRIPT_WORDS = frozenset("export default declare async abstract public private protected static readonly override get set accessor".split())
    _TYPE_SIGNS = frozenset((":", "|", "&", "=>", "<", ",", "is", "extends", "readonly", "keyof"))
    _NO_METHOD = frozenset("if for while switch catch with return function new typeof await do else throw delete void yield import super require in of instanceof case".split())

    def script(self, i: int) -> None:
        t, typed = self.at(i), self.language in TYPED
        first, begins = self.begins(i, self._SCRIPT_WORDS)
        if t == "function" and begins:
            star = self.at(i + 1) == "*"
            name = i + 1 + star
            if self.is_name(name):
                params = self.generics(name + 1)
                if self.at(params) == "(":
                    brace = self.body(self.past(params), self._TYPE_SIGNS)
                    end = self.close[brace] if brace is not None else self.expression(self.past(params)) if self.at(self.past(params)) == ":" else self.close[params]
                    self.add(first, end, "generator_function_declaration" if star else "function_declaration", self.at(name))
        elif t == "class" and begins and self.is_name(i + 1):
            brace = self.body(self.generics(i + 2), frozenset(("<", ",")))
            if brace is not None:
                self.classes[brace] = self.close[brace]
                self.add(first, self.close[brace], "abstract_class_declaration" if typed and "abstract" in (self.at(k) for k in range(first, i)) else "class_declaration", self.at(i + 1))
        elif typed and t == "interface" and begins and self.is_name(i + 1):
            brace = self.body(self.generics(i + 2), frozenset(("<", ",")))
            if brace is not None:
                self.add(first, self.close[brace], "interface_declaration", self.at(i + 1))
        elif typed and t == "type" and begins and self.is_name(i + 1) and self.at(self.generics(i + 2)) == "=":
            self.add(first, self.expression(self.generics(i + 2) + 1), "type_alias_declaration", self.at(i + 1))
        elif typed and t in ("const", "let", "var") and begins and self.depth_zero(i) and self.is_name(i + 1):
            self.arrow(i + 1)
        elif self.at(i + 1) in ("(", "<") and self.is_name(i) and t not in self._NO_METHOD:
            params = self.generics(i + 1)
            if self.at(params) == "(" and self.member(first):
                brace = self.body(self.past(params), self._TYPE_SIGNS) if self.at(self.past(params)) == ":" else self.past(params) if self.at(self.past(params)) == "{" else None
                if brace is not None:
                    self.add(first, self.close[brace], "method_definition", t)

    def member(self, first: int) -> bool:
        """Whether a member of a class or an object may begin at ``first``: at its own depth, after the
        brace, another member, a field or (in objects) a comma."""
        around = self.around(first)
        if around is None or self.at(around) != "{":
            return False
        before = self.at(first - 1)
        if around in self.classes:
            return before in ("{", "}", ";", "*", ")") or self.tokens[first].line > self.tokens[first - 1].line and before not in ("=", ".", "=>", "+", ",", "(", "?", "&&", "||")
        return before in ("{", ",") and self.at(around - 1) in ("=", "(", ",", ":", "[", "return", "default")

    def around(self, i: int) -> int | None:
        """The innermost open bracket around a place."""
        if not hasattr(self, "_around"):
            self._around, open_ = [], []
            for k in range(len(self.tokens)):
                while open_ and self.close[open_[-1]] <= k:
                    open_.pop()
                self._around.append(open_[-1] if open_ else None)
                if k in self.close:
                    open_.append(k)
        return self._around[i] if i < len(self._around) else None

    def depth_zero(self, i: int) -> bool:
        return self.around(i) is None

    def arrow(self, name: int) -> None:
        """A variable at the top that holds an arrow function."""
        i = name + 1
        if self.at(i) == ":":
            while i < len(self.tokens) and self.at(i) not in ("=", ";"):
                i = self.past(i)
        if self.at(i) != "=":
            return
        i += 1 + (self.at(i + 1) == "async")
        i = self.generics(i)
        if self.at(i) == "(":
            i = self.past(i)
            if self.at(i) == ":":
                while i < len(self.tokens) and self.at(i) not in ("=>", ";"):
                    i = self.past(i)
        elif self.is_name(i):
            i += 1
        if self.at(i) == "=>":
            end = self.close[i + 1] if self.at(i + 1) == "{" else self.expression(i + 1)
            self.add(name, end, "variable_declarator", self.at(name))

    def go(self, i: int) -> None:
        t = self.at(i)
        if not self.depth_zero(i) or t not in ("func", "type") or i and self.tokens[i].line == self.tokens[i - 1].line and self.at(i - 1) != ";":
            return
        if t == "func":
            method = self.at(i + 1) == "("
            name = self.past(i + 1) if method else i + 1
            params = self.past(name + 1) if self.at(name + 1) == "[" else name + 1
            if self.is_name(name) and self.at(params) == "(":
                brace = self.body(self.past(params), frozenset(("struct", "interface")))
                if brace is not None and self.tokens[brace].line == self.tokens[self.close[params]].line or brace is not None and self.at(self.past(params)) == "(":
                    self.add(i, self.close[brace], "method_declaration" if method else "function_declaration", self.at(name))
        elif self.at(i + 1) == "(":
            self.add(i, self.close[i + 1], "type_declaration", self.at(i + 2))
        elif self.is_name(i + 1):
            k, last = i + 2, i + 1
            while k < len(self.tokens) and self.tokens[k].line == self.tokens[last].line and self.at(k) != ";":
                last = self.close.get(k, k)
                k = last + 1
            self.add(i, last, "type_declaration", self.at(i + 1))

    _RUST_WORDS = frozenset("pub default const async unsafe extern crate".split())
    _RUST_KINDS = {"struct": "struct_item", "enum": "enum_item", "trait": "trait_item"}

    def rust(self, i: int) -> None:
        t = self.at(i)
        if t not in ("fn", "impl", *self._RUST_KINDS):
            return
        first, begins = self.begins(i, self._RUST_WORDS)
        if self.tokens[first - 1].literal and self.at(first - 2) == "extern":
            first, begins = self.begins(first - 2, self._RUST_WORDS)
        if not (begins or self.at(first - 1) == "]"):
            return
        if t == "impl":
            k, name = self.generics(i + 1), ""
            while k < len(self.tokens) and self.at(k) not in ("{", ";", "where"):
                if self.at(k) == "for":
                    name = ""
                elif self.is_name(k) and (not name or self.at(k - 1) == "::"):
                    name = self.at(k) if self.at(k) not in ("dyn", "mut") else ""
                k = self.generics(k) if self.at(k) == "<" and self.generics(k) > k else self.past(k)
            brace = self.body(k, frozenset())
            if brace is not None and name:
                self.add(first, self.close[brace], "impl_item", name)
        elif self.is_name(i + 1):
            brace, k = self.body(i + 2, frozenset()), i + 2
            if brace is not None:
                self.add(first, self.close[brace], self._RUST_KINDS.get(t, "function_item"), self.at(i + 1))
            elif t == "struct":
                while k < len(self.tokens) and self.at(k) != ";":
                    k = self.past(k)
                self.add(first, k, "struct_item", self.at(i + 1))

    _SCALA_WORDS = frozenset("override private protected final implicit inline lazy abstract sealed case open opaque transparent given infix".split())
    _SCALA_KINDS = {"class": "class_definition", "trait": "trait_definition", "object": "object_definition"}

    def scala(self, i: int) -> None:
        t = self.at(i)
        if t not in ("def", *self._SCALA_KINDS) or not (self.is_name(i + 1) or t == "def" and re.fullmatch(r"[^\w\s(){}\[\]]+", self.at(i + 1) or " ")):
            return
        first, begins = self.begins(i, self._SCALA_WORDS)
        if not (begins or self.at(first - 1) in ("]", ")", "package")):
            return
        indent, k, last, brace, equals = self.indents[self.tokens[first].line - 1], i + 2, i + 1, None, False
        while k < len(self.tokens):
            here = self.tokens[k]
            if here.line > self.tokens[last].line and self.indents[here.line - 1] <= indent and self.at(k) not in ("{", "extends", "with") or self.at(k) in (";", "}", ")"):
                break
            equals |= self.at(k) == "="
            if self.at(k) == "{" and (t != "def" or self.at(k - 1) in ("=", "=>", ")", "]") or equals):
                brace = k
                if t != "def" or self.at(k - 1) == "=":
                    last = self.close[k]
                    break
            last = self.close.get(k, k)
            k = last + 1
        kind = self._SCALA_KINDS.get(t) or ("function_definition" if equals or brace is not None else "function_declaration")
        self.add(first, last, kind, self.at(i + 1))


def brace_nodes(text: str | None, language: str | None) -> list[tuple[int, int, str, str, str]] | None:
    """(first line, last line, kind, symbol, comment above) of definitions, an outer one before those
    in it; None for languages without a parser here and for texts that are too large."""
    if text is None or language not in LANGUAGES or len(text) > AST_MAX:
        return None
    lines = text.split("\n")
    out, walk = [], _Walk(text, language)
    code = {t.line + k for t in walk.tokens for k in range(t.text.count("\n") + 1)}
    for first, last, kind, name in walk.run():
        above = []
        for k in range(first - 2, -1, -1):
            said = lines[k].strip()
            if said.startswith(("#[", "@")):
                continue
            # A line with something on it but no token is one of a comment.
            if not said or k + 1 in code:
                break
            above.append(lines[k])
        out.append((first, last, kind, name, "\n".join(reversed(above))))
    return out
