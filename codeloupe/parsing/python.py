"""Python sources by the standard library's syntax tree."""

from __future__ import annotations

import ast
import io
import keyword
import re
import tokenize

from codeloupe.functions.text import literal_words
from codeloupe.parsing.registry import Parsed, Symbol

FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def span(node: ast.AST) -> tuple[int, int]:
    """First line, decorators included, and last line."""
    return min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))]), node.end_lineno


def line_tokens(text: str) -> dict[int, list[str]]:
    """Names but keywords, comments and the words of string literals by line."""
    found: dict[int, list[str]] = {}
    for t in tokenize.generate_tokens(io.StringIO(text).readline):
        if t.type == tokenize.NAME and not keyword.iskeyword(t.string) or t.type == tokenize.COMMENT:
            found.setdefault(t.start[0], []).append(t.string)
        elif t.type == tokenize.STRING or t.type == getattr(tokenize, "FSTRING_MIDDLE", -1):
            found.setdefault(t.start[0], []).extend(literal_words(t.string))
    return found


#: Repairs of one file at most.
REPAIRS = 200


def repaired(text: str) -> tuple[str, ast.Module]:
    """A text and its tree; lines that are no Python are made blank, so that the rest keeps its line numbers."""
    text = text.replace("\0", " ").removeprefix("\ufeff")
    for _ in range(REPAIRS):
        try:
            return text, ast.parse(text)
        except SyntaxError as error:
            lines = text.split("\n")
            empty = re.search(r"after .* on line (\d+)", error.msg) if isinstance(error, IndentationError) else None
            at = min(max((int(empty[1]) if empty else error.lineno or 1) - 1, 0), len(lines) - 1)
            if empty:
                lines[at] += " pass"
            else:
                while at and not lines[at].strip():
                    at -= 1
                lines[at] = ""
            if "\n".join(lines) == text:
                raise
            text = "\n".join(lines)
    return text, ast.parse(text)


def parse(text: str) -> Parsed:
    text, tree = repaired(text)
    found = Parsed()
    tokens = line_tokens(text)
    chosen: list[tuple[ast.AST, str]] = [(n, "class" if isinstance(n, ast.ClassDef) else "function") for n in tree.body if isinstance(n, (*FUNCTIONS, ast.ClassDef))]
    for c in ast.walk(tree):
        if isinstance(c, ast.ClassDef):
            chosen += [(n, "method") for n in c.body if isinstance(n, FUNCTIONS)]
    for node, kind in sorted(chosen, key=lambda x: (span(x[0])[0], -span(x[0])[1])):
        start, end = span(node)
        found.symbols.append(Symbol(node.name, kind, start, end, tokens=[t for line in range(start, end + 1) for t in tokens.get(line, ())]))
    calls, values = [], []
    for n in ast.walk(tree):
        if isinstance(n, ast.Call):
            if isinstance(n.func, ast.Name):
                calls.append((n.func.id, n.func.lineno))
            elif isinstance(n.func, ast.Attribute):
                calls.append((n.func.attr, n.func.end_lineno))
            values += [(k.value.id, k.value.lineno) for k in n.keywords if k.arg and isinstance(k.value, ast.Name)]
        elif isinstance(n, ast.Assign) and isinstance(n.value, ast.Name):
            values.append((n.value.id, n.value.lineno))
        elif isinstance(n, ast.Dict):
            values += [(v.id, v.lineno) for v in n.values if isinstance(v, ast.Name)]
        elif isinstance(n, ast.Import):
            found.imports += [(a.name, a.asname or "", a.lineno) for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            found.imports.append(("." * n.level + (n.module or ""), "", n.lineno))
    found.calls = sorted(calls, key=lambda c: c[1]) + sorted(values, key=lambda c: c[1])
    return found
