"""The language of a file by the ending of its name, and of a diff by its files.

A path is looked up in a literal map of endings and of whole names, within the JVM: no worker needs
a library for it, and all answer alike. Defined results: null and empty paths, unknown endings, and
text and data (JSON, Markdown, plain text) have no language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings of code, by the short name of their language.
ENDINGS = {
    "awk": ("awk",),
    "batch": ("bat", "cmd"),
    "c": ("c", "h"),
    "clojure": ("clj",),
    "clojurescript": ("cljs",),
    "cmake": ("cmake",),
    "coffeescript": ("coffee",),
    "common-lisp": ("lisp",),
    "cpp": ("cc", "cpp", "cxx", "hh", "hpp", "hxx"),
    "csharp": ("cs",),
    "css": ("css",),
    "cuda": ("cu",),
    "cython": ("pxd", "pyx"),
    "d": ("d",),
    "dart": ("dart",),
    "diff": ("diff", "patch"),
    "elixir": ("ex", "exs"),
    "elm": ("elm",),
    "emacs-lisp": ("el",),
    "erlang": ("erl", "hrl"),
    "fish": ("fish",),
    "fortran": ("f90",),
    "fsharp": ("fsx",),
    "gas": ("s",),
    "go": ("go",),
    "graphql": ("graphql",),
    "groovy": ("gradle", "groovy"),
    "haskell": ("hs",),
    "html": ("htm", "html", "xhtml"),
    "java": ("java",),
    "javascript": ("cjs", "js", "mjs"),
    "jsx": ("jsx",),
    "julia": ("jl",),
    "kotlin": ("kt", "kts"),
    "less": ("less",),
    "lua": ("lua",),
    "make": ("mk",),
    "nasm": ("asm",),
    "nimrod": ("nim",),
    "nixos": ("nix",),
    "objective-c": ("m",),
    "objective-c++": ("mm",),
    "ocaml": ("ml", "mli"),
    "php": ("php",),
    "powershell": ("ps1", "psm1"),
    "properties": ("properties",),
    "protobuf": ("proto",),
    "python": ("bzl", "py", "pyi", "pyw"),
    "racket": ("rkt",),
    "ruby": ("rb",),
    "rust": ("rs",),
    "sass": ("sass",),
    "scala": ("scala",),
    "scheme": ("scm",),
    "scss": ("scss",),
    "shell": ("bash", "ksh", "sh", "zsh"),
    "solidity": ("sol",),
    "splus": ("R",),
    "swift": ("swift",),
    "tcl": ("tcl",),
    "terraform": ("hcl", "tf"),
    "tex": ("tex",),
    "toml": ("toml",),
    "tsql": ("sql",),
    "tsx": ("tsx",),
    "typescript": ("ts",),
    "verilog": ("v",),
    "vim": ("vim",),
    "vue": ("vue",),
    "xml": ("svg", "xml"),
    "yaml": ("yaml", "yml"),
    "zig": ("zig",),
}
#: Whole names of files that have a language without an ending.
WHOLE = {
    "BUILD": "python",
    "CMakeLists.txt": "cmake",
    "Dockerfile": "docker",
    "GNUmakefile": "make",
    "Gemfile": "ruby",
    "Makefile": "make",
    "Rakefile": "ruby",
    "SConstruct": "python",
    "Vagrantfile": "ruby",
    "WORKSPACE": "python",
    "makefile": "make",
}
BY_SIGN = {f".{ending}": language for language, endings in ENDINGS.items() for ending in endings} | WHOLE


def signs(name: str) -> tuple[str, str]:
    """What a name may be known by: itself, and its ending with the dot."""
    return name, name[name.rfind(".") :] if "." in name else name


def of_name(name: str | None) -> str | None:
    """The language of one file's name."""
    return next((BY_SIGN[s] for s in signs(name or "") if s in BY_SIGN), None)


def language_of_path(path: Column) -> Column:
    """The language of a path."""
    return _lookup(F.substring_index(path, "/", -1))


def _lookup(name: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in BY_SIGN.items() for x in pair))
    return F.coalesce(F.try_element_at(known, name), F.try_element_at(known, F.regexp_extract(name, r"\.[^.]*$", 0)))


def language_of_diff(diff: Column) -> Column:
    """The language of the first changed file of a diff that has one."""
    names = F.transform(F.regexp_extract_all(diff, F.lit(r"(?m)^\+\+\+ b/(\S[^\t\r\n]*)"), F.lit(1)), lambda p: _lookup(F.substring_index(p, "/", -1)))
    return F.get(F.filter(names, lambda x: x.isNotNull()), F.lit(0))
