"""Languages by file extension, and the parser of each.

A parser is a function of a file's text that returns a ``Parsed``. Python is read with the standard
library's ``ast`` and is exact; the other languages are read by a token scanner with bracket
matching, which is an approximation of a grammar. ``register`` adds or replaces one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from codeloupe.model import PARSED

EXTENSIONS = {
    ".go": "go", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".mts": "typescript", ".cts": "typescript", ".tsx": "tsx",
    ".py": "python", ".pyw": "python", ".cs": "csharp", ".rs": "rust", ".swift": "swift",
}
#: Folders, besides those that begin with a dot, that hold no sources of one's own.
SKIPPED = ("node_modules", "vendor")
#: Types of symbols that can be a parent.
CONTAINERS = ("class", "interface", "enum", "namespace")
#: Types of symbols that get a parent; functions, constructors among them, and type aliases have none.
CHILDREN = (*CONTAINERS, "method", "variable")


@dataclass
class Symbol:
    name: str
    type: str
    start_line: int
    end_line: int
    parent: str = ""
    tokens: list[str] = field(default_factory=list)


@dataclass
class Parsed:
    """Symbols in document order, calls followed by value references, and imports by line."""

    symbols: list[Symbol] = field(default_factory=list)
    calls: list[tuple[str, int]] = field(default_factory=list)
    imports: list[tuple[str, str, int]] = field(default_factory=list)


PARSERS: dict[str, Callable[[str], Parsed]] = {}


def register(language: str, parser: Callable[[str], Parsed], *extensions: str) -> None:
    PARSERS[language] = parser
    EXTENSIONS.update(dict.fromkeys(extensions, language))


def with_parents(symbols: list[Symbol]) -> list[Symbol]:
    """Gives each symbol of ``CHILDREN`` the last container before it that reaches its line.

    Nested namespaces are named in full: a namespace inside another one gets its name in front, and
    so do the parents of what is in it.
    """
    full: dict[int, str] = {}
    open_: list[tuple[int, Symbol]] = []
    for k, s in enumerate(symbols):
        while open_ and open_[-1][1].end_line < s.start_line:
            open_.pop()
        if open_ and s.type in CHILDREN:
            i, outer = open_[-1]
            s.parent = full.get(i, outer.name)
        if s.type in CONTAINERS:
            full[k] = f"{s.parent}.{s.name}" if s.type == "namespace" and open_ and open_[-1][1].type == "namespace" else s.name
            open_.append((k, s))
    return symbols


def unique_imports(found: list[tuple[str, str, int]]) -> list[tuple[str, str, int]]:
    """One import for each line and path, the first with an alias if one has; by line."""
    kept: dict[tuple[int, str], str] = {}
    for path, alias, line in found:
        if not kept.get((line, path)):
            kept[line, path] = alias
    return [(path, alias, line) for (line, path), alias in sorted(kept.items(), key=lambda x: x[0][0])]


def parsers() -> dict[str, Callable[[str], Parsed]]:
    """All parsers, the library's own among them."""
    from codeloupe.parsing import python, scanner

    for language, parser in {"python": python.parse, **scanner.PARSERS}.items():
        PARSERS.setdefault(language, parser)
    return PARSERS


def parse(language: str, text: str) -> Parsed:
    """The parser's result for a text of a language, with parents and distinct imports."""
    return finished(parsers()[language](text))


def finished(found: Parsed) -> Parsed:
    found.symbols = with_parents(found.symbols)
    found.imports = unique_imports(found.imports)
    return found


def parser_udf():
    """A column function of path, language and content that gives a ``PARSED`` struct; an error is a value.

    Files travel in Arrow batches. The parsers registered by now travel with it.
    """
    known, kind = dict(parsers()), to_arrow_type(_parse_datatype_string(PARSED))

    def parse_file(language: str, content: bytes) -> dict:
        try:
            found = finished(known[language]((content or b"").decode("utf-8", "replace")))
        except Exception as error:  # one bad file must not end the run
            return {"symbols": [], "calls": [], "imports": [], "error": f"{type(error).__name__}: {error}"}
        return {
            "symbols": [{"ord": k, "name": s.name, "type": s.type, "start_line": s.start_line, "end_line": s.end_line, "parent": s.parent, "body_tokens": sorted(set(s.tokens))} for k, s in enumerate(found.symbols)],
            "calls": [{"ord": k, "callee_name": name, "line": line} for k, (name, line) in enumerate(found.calls)],
            "imports": [{"import_path": path, "alias": alias, "line": line} for path, alias, line in found.imports],
            "error": None,
        }

    @F.arrow_udf(PARSED)
    def parse_files(path: pa.Array, language: pa.Array, content: pa.Array) -> pa.Array:
        return pa.array([parse_file(*row) for row in zip(language.to_pylist(), content.to_pylist())], kind)

    return parse_files.asNondeterministic()  # else filters on its result would run it again
