"""Token scanner for the languages with braces: Go, JavaScript, TypeScript, C#, Rust and Swift.

A text becomes tokens with lines, and brackets know their partners. Declarations are recognised by
the tokens they begin with and by the block they stand in; blocks of functions are not searched for
declarations of members. This approximates the languages' grammars: code that only a grammar can
tell apart, like a regular expression from a division, may be read wrongly.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

from codeloupe.functions.text import literal_words
from codeloupe.parsing.registry import Parsed, Symbol

COMMENT = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
STRINGS = {
    "go": r'"(?:\\.|[^"\\\n])*"|`[^`]*`|\'(?:\\.|[^\'\\\n])+\'',
    "js": r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`',
    "csharp": r'(?:\$?@|@\$)"(?:""|[^"])*"|\$?"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])+\'',
    "rust": r'b?r(?P<hashes>#*)".*?"(?P=hashes)|b?"(?:\\.|[^"\\])*"|b?\'(?:\\.[^\']*|[^\'\\\n])\'|\'[a-z_]\w*',
    "swift": r'""".*?"""|"(?:\\.|[^"\\\n])*"',
}
IDENT = r"[^\W\d]\w*"
PAIRS = {"(": ")", "[": "]", "{": "}"}
#: Keywords that may stand before a bracket without being called.
KEYWORDS = {
    "go": "if for switch return func case go defer select range else type var const struct interface map chan import package",
    "javascript": "if for while switch return function catch with case do else try throw typeof instanceof in of as new await yield let var const class super import export void delete async from",
    "csharp": "if for foreach while switch return catch case do else try throw typeof sizeof nameof default new await yield lock using fixed when is as in base this where checked unchecked and or not out ref var public private protected internal static sealed abstract partial readonly override virtual extern unsafe volatile implicit explicit operator",
    "rust": "if for while loop match return fn else let mut in as use pub impl trait struct enum mod where unsafe move async await self super crate ref dyn box",
    "swift": "if for while switch return func catch case do else try throw guard where in is as await let var init super self defer repeat some any inout",
}
KEYWORDS |= dict.fromkeys(("typescript", "tsx"), KEYWORDS["javascript"])
#: Words of a language that are no identifiers: they say nothing of what a body is about.
RESERVED = {
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var nil true false iota",
    "javascript": "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof let new return static super switch this throw try typeof var void while with yield async await of null true false undefined",
    "csharp": "abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null object operator out override params private protected public readonly ref return sbyte sealed short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using var virtual void volatile while record async await where partial",
    "rust": "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self static struct super trait true type union unsafe use where while bool char str u8 u16 u32 u64 u128 usize i8 i16 i32 i64 i128 isize f32 f64",
    "swift": "associatedtype class deinit enum extension fileprivate func import init inout internal let open operator private protocol public rethrows static struct subscript typealias var break case continue default defer do else fallthrough for guard if in repeat return switch where while as catch false is nil super self throw throws true try final override mutating",
}
RESERVED |= dict.fromkeys(("typescript", "tsx"), RESERVED["javascript"] + " abstract declare enum implements interface namespace private protected public readonly type any boolean number unknown never object symbol")
#: Names that are values, but of no symbol.
CONSTANTS = frozenset("nil null true false undefined iota self this super func function new async await class number string boolean any void unknown never object bigint symbol".split())


@dataclass
class Token:
    kind: str  # ident, string, number, sign, comment
    text: str
    line: int
    pair: int = -1  # of brackets, the partner's number


def tokens(text: str, language: str) -> tuple[list[Token], list[Token]]:
    """Tokens but comments, with bracket partners; comments apart."""
    strings = STRINGS["js" if language in ("javascript", "typescript", "tsx") else language]
    token = re.compile(rf"(?P<comment>{COMMENT})|(?P<string>{strings})|(?P<ident>[@$]?{IDENT}(?:\$\w*)*)|(?P<number>\d[\w.]*)|(?P<sign>=>|->|:=|::|\.\.\.|==|!=|<=|>=|&&|\|\||\S)", re.S)
    breaks = [i for i, c in enumerate(text) if c == "\n"]
    found, comments, stack = [], [], []
    for m in token.finditer(text):
        kind = next(k for k in ("comment", "string", "ident", "number", "sign") if m[k] is not None)
        t = Token(kind, m[0].lstrip("@") if kind == "ident" else m[0], bisect_right(breaks, m.start()) + 1)
        if kind == "comment":
            comments.append(t)
            continue
        if kind == "sign" and t.text in PAIRS:
            stack.append((PAIRS[t.text], len(found)))
        elif kind == "sign" and t.text in PAIRS.values():
            # A bracket may lack its partner: look a few levels out for one that fits.
            for k in range(len(stack) - 1, max(-1, len(stack) - 4), -1):
                if stack[k][0] == t.text:
                    t.pair = stack[k][1]
                    found[t.pair].pair = len(found)
                    del stack[k:]
                    break
        found.append(t)
    return found, comments


class Scan:
    """A walk over one file's tokens; subclasses name what declarations of a language look like."""

    language = ""
    types: dict[str, str] = {}

    def __init__(self, text: str):
        self.text = text
        self.t, self.comments = tokens(text, self.language)
        self.last_line = text.count("\n") + (not text.endswith("\n"))
        self.out = Parsed()
        self.declared: set[int] = set()  # tokens that name a declaration, not a call
        self.keywords = frozenset(KEYWORDS[self.language].split())
        self.reserved = frozenset(RESERVED[self.language].split())

    def at(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) else ""

    def kind(self, i: int) -> str:
        return self.t[i].kind if 0 <= i < len(self.t) else ""

    def line(self, i: int) -> int:
        return self.t[min(max(i, 0), len(self.t) - 1)].line if self.t else 1

    def same_line(self, i: int, j: int) -> bool:
        return self.line(i) == self.line(j)

    def close(self, i: int) -> int:
        """The number of the bracket that closes the one at ``i``, or of the last token."""
        return self.t[i].pair if i < len(self.t) and self.t[i].pair > i else len(self.t) - 1

    def find(self, i: int, stops: str, limit: int | None = None) -> int:
        """The first of some signs from ``i`` on, outside of round and square brackets."""
        limit = len(self.t) if limit is None else limit
        while i < limit:
            x = self.at(i)
            if self.kind(i) == "sign":
                if x in stops.split():
                    return i
                if x in "([" and self.t[i].pair > i:
                    i = self.t[i].pair
                elif x in ")]}" :
                    return i
            i += 1
        return limit

    def statement_end(self, i: int, limit: int) -> int:
        """The last token of a statement that ends at ``;`` or with its line, brackets skipped."""
        while i < limit:
            if self.kind(i) == "sign" and self.at(i) in PAIRS and self.t[i].pair > i:
                i = self.t[i].pair
            if self.at(i) == ";":
                return i
            nxt = i + 1
            if nxt >= limit or self.at(nxt) in (")", "]", "}"):
                return i
            if not self.same_line(i, nxt) and self.at(i) not in ("=", ":=", ",", "=>", "+", "-", "|", "&", "&&", "||", ".", ":", "->", "?") and self.at(nxt) not in (".", "?", ":", "+", "-", "|", "&", "&&", "||", "=", "=>"):
                return i
            i = nxt
        return max(limit - 1, i - 1)

    def add(self, name: int, kind: str, start: int, end: int) -> Symbol:
        self.declared.add(name)
        last = self.t[end].line if end < len(self.t) else self.last_line
        last += self.t[end].text.count("\n") if end < len(self.t) and self.t[end].kind == "string" else 0
        s = Symbol(self.at(name), kind, self.line(start), max(last, self.line(start)))
        words = []
        for x in self.t[start : end + 1]:
            if x.kind == "ident":
                words += [x.text] if x.text not in self.reserved else []
            elif x.kind == "string":
                words += literal_words(x.text)
        words += [c.text for c in self.comments if s.start_line <= c.line <= s.end_line]
        s.tokens = words
        self.out.symbols.append(s)
        return s

    def block(self, i: int, limit: int) -> tuple[int, int]:
        """The braces of a declaration's body from ``i`` on, or twice the end of the statement without one."""
        k = self.find(i, "{ ;", limit)
        if self.at(k) == "{":
            return k, self.close(k)
        end = k if self.at(k) == ";" else min(k, limit) - 1
        return end, end

    def run(self) -> Parsed:
        self.members(0, len(self.t), None)
        self.out.symbols.sort(key=lambda s: (s.start_line, -s.end_line))
        self.references()
        return self.out

    def members(self, i: int, limit: int, owner: Symbol | None) -> None:
        while i < limit:
            i = max(self.declaration(i, limit, owner), i + 1)

    def declaration(self, i: int, limit: int, owner: Symbol | None) -> int:
        """Reads a declaration that begins at ``i``; where to go on."""
        raise NotImplementedError

    def skip(self, i: int) -> int:
        return self.t[i].pair + 1 if self.kind(i) == "sign" and self.at(i) in PAIRS and self.t[i].pair > i else i + 1

    def references(self) -> None:
        calls, values = [], []
        for i, x in enumerate(self.t):
            if x.kind != "ident":
                continue
            after = i + 1
            if self.language == "rust" and self.at(after) == "::" and self.at(after + 1) == "<":
                after = self.generic_end(after + 1)
            elif self.language == "go" and self.at(after) == "[" and self.type_arguments(after):
                after = self.close(after) + 1
            elif self.language not in ("javascript", "rust", "go", "csharp") and self.at(after) == "<":
                after = self.generic_end(after)
            if self.at(after) == "(" and self.is_call(i):
                calls.append((x.text, x.line))
            elif self.is_value(i):
                values.append((x.text, x.line))
        self.out.calls = calls + self.extra_calls() + values

    def generic_end(self, i: int) -> int:
        """Behind a list of type arguments at ``i``, if it is one."""
        depth, k = 0, i
        while k < min(len(self.t), i + 40):
            x = self.at(k)
            if x == "<":
                depth += 1
            elif x == ">":
                depth -= 1
                if not depth:
                    return k + 1
            elif self.kind(k) not in ("ident", "number") and x not in (",", ".", "::", "[", "]", "?", "&", ":"):
                return i
            k += 1
        return i

    def type_arguments(self, i: int) -> bool:
        """Whether square brackets at ``i`` hold types, as far as tokens tell: names, and what makes types of them."""
        inside = range(i + 1, self.close(i))
        return len(inside) > 0 and self.at(self.close(i) + 1) == "(" and all(self.kind(k) == "ident" or self.at(k) in (".", ",", "*", "[", "]") for k in inside)

    def is_call(self, i: int) -> bool:
        return i not in self.declared and self.at(i) not in self.keywords and self.at(i - 1) not in ("func", "function", "fn", "new", "class")

    VALUE_BEFORE, VALUE_AFTER = ("=", ":=", ":"), (",", "}", ";", ")", "")

    def is_value(self, i: int) -> bool:
        """Whether a name stands alone as what is assigned or a key's value."""
        if self.at(i - 1) not in self.VALUE_BEFORE or i in self.declared or self.at(i) in CONSTANTS or self.at(i - 3) == "typealias":
            return False
        ends = self.at(i + 1) in self.VALUE_AFTER or not self.same_line(i, i + 1) and self.at(i + 1) not in (".", "(", "=>")
        return ends and (self.at(i - 1) != ":" or self.keyed(i))

    def keyed(self, i: int) -> bool:
        """Whether the colon before ``i`` belongs to a key of a literal."""
        return self.kind(i - 2) in ("ident", "string") and self.at(i - 3) in ("{", ",") and self.at(i + 1) in (",", "}", "")

    def extra_calls(self) -> list[tuple[str, int]]:
        return []


def unquoted(text: str) -> str:
    return text.strip("`'\"")


class Go(Scan):
    language = "go"

    def declaration(self, i, limit, owner):
        x = self.at(i)
        if x == "import":
            return self.imports(i)
        if x == "func":
            name, kind = i + 1, "function"
            if self.at(name) == "(":
                name, kind = self.close(name) + 1, "method"
            if self.kind(name) == "ident":
                start = self.find(name, "{", limit)
                while self.at(start - 1) in ("interface", "struct") and start < limit:
                    start = self.find(self.close(start) + 1, "{", limit)
                end = self.close(start) if self.at(start) == "{" else self.statement_end(name, limit)
                self.add(name, kind, i, end)
                return end + 1
        if x in ("type", "var", "const"):
            if self.at(i + 1) == "(":
                end = self.close(i + 1)
                k = i + 2
                while k < end:
                    k = self.spec(x, k, k, end) + 1
                return end + 1
            return self.spec(x, i + 1, i, limit) + 1
        return self.skip(i)

    def spec(self, word: str, name: int, start: int, limit: int) -> int:
        if self.kind(name) != "ident":
            return name
        end = self.statement_end(name, limit)
        if word == "type":
            k = name + 1
            if self.at(k) == "[" and self.kind(k + 1) == "ident" and self.kind(k + 2) == "ident":
                k = self.close(k) + 1
            kind = {"struct": "class", "interface": "interface"}.get(self.at(k), "type_alias")
            self.add(name, kind, start, end)
            if kind == "interface":  # its methods are declared, not called
                self.declared.update(k for k in range(k, end) if self.kind(k) == "ident" and self.at(k + 1) == "(")
        elif word == "var":
            k = name
            while True:
                self.add(k, "variable", start, end)
                if self.at(k + 1) != ",":
                    break
                k += 2
        elif any(self.at(k) == "iota" for k in range(name, end + 1)):
            self.add(name, "enum", start, end)
        return end

    def imports(self, i: int) -> int:
        lo, hi = (i + 2, self.close(i + 1)) if self.at(i + 1) == "(" else (i + 1, min(i + 3, len(self.t)))
        for k in range(lo, hi):
            if self.kind(k) == "string":
                alias = self.at(k - 1) if k - 1 >= lo and self.same_line(k - 1, k) and (self.kind(k - 1) == "ident" or self.at(k - 1) == ".") else ""
                self.out.imports.append((unquoted(self.at(k)), alias, self.line(k)))
                if self.at(i + 1) != "(":
                    return k + 1
        return hi + 1


class JavaScript(Scan):
    language = "javascript"
    typed, jsx = False, True
    MODIFIERS = frozenset("static async get set public private protected readonly abstract override declare accessor".split())

    def declaration(self, i, limit, owner):
        x = self.at(i)
        if x == "import" and self.at(i + 1) not in ("(", "."):
            end = self.statement_end(i, limit)
            k = next((k for k in range(i + 1, min(i + 400, len(self.t))) if self.kind(k) == "string"), None)
            if k is not None and (self.at(k - 1) in ("from", "import") or self.at(k - 1) == "("):
                self.out.imports.append((unquoted(self.at(k)), "", self.line(k)))
                return k + 1
            return end + 1
        if owner is not None:
            return self.member(i, limit, owner)
        start = i
        while self.at(start - 1) in ("export", "default", "async", "abstract", "declare") and self.kind(start - 1) == "ident":
            start -= 1
        while start < i and self.at(start) in ("export", "default", "declare"):
            start += 1
        if x == "function":
            name = i + 1 + (self.at(i + 1) == "*")
            if self.kind(name) == "ident":
                lo, end = self.block(name, limit)
                self.add(name, "function", start, end)
                self.members(lo + 1, end, None)
                return end + 1
        if x == "class" and self.kind(i + 1) == "ident" and self.at(i + 1) not in ("extends", "implements"):
            lo, end = self.block(i + 1, limit)
            s = self.add(i + 1, "class", start, end)
            self.members(lo + 1, end, s)
            return end + 1
        if self.typed and (found := self.typed_declaration(i, start, limit)):
            return found
        if x in ("const", "let", "var"):
            k = i + 1
            if self.kind(k) == "ident":
                eq = self.find(k + 1, "= ; ,", limit) if self.at(k + 1) in (":", "=") else k
                if self.at(eq) == "=" and (body := self.function_value(eq + 1, limit)):
                    self.add(k, "function", k, body)
                    return eq + 1
        if self.kind(i) == "ident" and self.at(i - 1) == "." and self.at(i + 1) == "=" and self.at(i + 2) in ("function", "async") and (body := self.function_value(i + 2, limit)):
            self.add(i, "function", self.chain_start(i), body)
        return i + 1

    def chain_start(self, i: int) -> int:
        while self.at(i - 1) == "." and self.kind(i - 2) == "ident":
            i -= 2
        return i

    def function_value(self, k: int, limit: int) -> int | None:
        """The last token of a function expression or arrow function at ``k``."""
        k += self.at(k) == "async"
        if self.at(k) == "function":
            return self.block(k + 1, limit)[1]
        if self.at(k) == "<":
            k = self.generic_end(k)
        if self.at(k) == "(":
            k = self.close(k) + 1
            if self.at(k) == ":":
                k = self.find(k + 1, "=> ; =", limit)
        elif self.kind(k) == "ident":
            k += 1
        if self.at(k) != "=>":
            return None
        return self.close(k + 1) if self.at(k + 1) == "{" else self.statement_end(k + 1, limit)

    def typed_declaration(self, i: int, start: int, limit: int) -> int | None:
        x, name = self.at(i), i + 1
        if x not in ("interface", "type", "enum", "namespace", "module") or self.kind(name) not in ("ident", "string") or self.at(i - 1) == ".":
            return None
        if x == "type":
            if self.at(self.generic_end(name + 1) if self.at(name + 1) == "<" else name + 1) != "=":
                return None
            end = self.statement_end(name, limit)
            self.add(name, "type_alias", start, end)
            return end + 1
        lo, end = self.block(name, limit)
        if self.at(lo) != "{":
            return None
        start = start - (self.at(start - 1) == "const")
        self.add(name, {"interface": "interface", "enum": "enum"}.get(x, "namespace"), start, end)
        if x in ("namespace", "module"):
            self.members(lo + 1, end, None)
        return end + 1

    def member(self, i: int, limit: int, owner: Symbol) -> int:
        start = i
        while self.at(i) in self.MODIFIERS and self.at(i + 1) not in ("(", "=", ";", ":") or self.at(i) == "*":
            i += 1
        if self.at(i) == "@":
            return i + 1
        name = i + (self.at(i) == "#")
        if self.kind(name) == "ident":
            k = self.generic_end(name + 1) if self.at(name + 1) == "<" else name + 1
            if self.at(k) == "(":
                close = self.close(k)
                after = close + 1
                if self.at(after) == ":":
                    after = self.find(after + 1, "{ ;", limit)
                if self.at(after) == "{" or self.typed and "abstract" in [self.at(j) for j in range(start, name)]:
                    end = self.close(after) if self.at(after) == "{" else after
                    self.add(name, "method", start, end)
                    if self.at(after) == "{":
                        self.members(after + 1, end, None)
                    return end + 1
            if self.at(name + 1) in ("=", ":") and self.at(self.find(name + 1, "= ;", limit)) == "=":
                return self.statement_end(name, limit) + 1
        return self.skip(i)

    def is_call(self, i):
        return super().is_call(i) and not (self.at(i) == "constructor")

    def extra_calls(self):
        if not self.jsx:
            return []
        found = []
        for i, x in enumerate(self.t):
            if x.text == "<" and self.kind(i + 1) == "ident" and self.at(i + 1)[:1].isupper() and self.at(i - 1) in ("(", ">", "return", "{", "?", ":", "&&", "||", "=>", "=", ",", "}", "[", "") or x.text == "<" and self.kind(i + 1) == "ident" and self.at(i + 1)[:1].isupper() and self.kind(i - 1) == "ident" and not self.same_line(i - 1, i):
                k = i + 1
                while self.at(k + 1) == "." and self.kind(k + 2) == "ident":
                    k += 2
                found.append((self.at(k), self.line(k)))
        return found


class TypeScript(JavaScript):
    language, typed, jsx = "typescript", True, False


class Tsx(JavaScript):
    language, typed, jsx = "tsx", True, True


class CSharp(Scan):
    language = "csharp"
    VALUE_BEFORE = ("=",)
    MODIFIERS = frozenset("public private protected internal static sealed abstract partial readonly async override virtual extern unsafe new volatile const required file ref event".split())

    def declaration(self, i, limit, owner):
        x = self.at(i)
        if x == "[" and self.t[i].pair > i:
            return self.t[i].pair + 1
        if x == "using" and self.at(i + 1) != "(" and owner is None or x == "global" and self.at(i + 1) == "using":
            end = self.find(i, ";", limit)
            k = i + 1 + (x == "global")
            k += self.at(k) == "static"
            alias = ""
            if self.at(k + 1) == "=":
                alias, k = self.at(k), k + 2
            if self.kind(k) == "ident":
                self.out.imports.append(("".join(self.at(j) for j in range(k, end)), alias, self.line(k)))
            return end + 1
        if x == "namespace":
            stop = self.find(i + 1, "{ ;", limit)
            name = "".join(self.at(j) for j in range(i + 1, stop))
            whole = self.at(stop) == ";"
            end = len(self.t) - 1 if whole else self.close(stop)
            s = self.add(i + 1, "namespace", i, end)
            s.name = name
            if whole:
                s.end_line = self.last_line
                return stop + 1
            self.members(stop + 1, end, None)
            return end + 1
        start = i
        while self.at(i) in self.MODIFIERS:
            i += 1
        x = self.at(i)
        if x in ("class", "struct", "interface", "enum", "record"):
            name = i + 1 + (x == "record" and self.at(i + 1) in ("class", "struct"))
            if self.kind(name) == "ident":
                lo, end = self.block(name, limit)
                s = self.add(name, {"interface": "interface", "enum": "enum"}.get(x, "class"), start, end)
                if x != "enum" and self.at(lo) == "{":
                    self.members(lo + 1, end, s)
                return end + 1
        if x == "delegate":
            stop = self.find(i, "; (", limit)
            self.add(stop - 1, "type_alias", start, self.find(stop, ";", limit))
            return self.find(stop, ";", limit) + 1
        if owner is not None and owner.type in ("class", "interface"):
            return self.member(start, i, limit, owner)
        return self.skip(i)

    def member(self, start: int, i: int, limit: int, owner: Symbol) -> int:
        k = i
        # A member's name is the last identifier before its ( { = ; or =>.
        while k < limit:
            x = self.at(k)
            if x == "(" and k > i and (self.kind(k - 1) == "ident" or self.at(k - 1) == ">") or x in ("{", ";", "=", "=>"):
                break
            if x == "<":
                after = self.generic_end(k)
                k = after if after > k else k + 1
            elif x in ("(", "[") and self.t[k].pair > k:
                k = self.t[k].pair + 1
            elif x == "}":
                return k + 1
            else:
                k += 1
        name = k - 1
        if self.at(name) == ">":  # of a generic member, the name before its type parameters
            depth = 0
            for j in range(name, i, -1):
                depth += (self.at(j) == ">") - (self.at(j) == "<")
                if not depth:
                    name = j - 1
                    break
        x = self.at(k)
        if self.kind(name) != "ident" or name < i:
            return self.skip(k)
        if x == "(":
            after = self.close(k) + 1
            stop = self.find(after, "{ ; =>", limit)
            end = self.close(stop) if self.at(stop) == "{" else self.find(stop, ";", limit)
            if name == i and self.at(name) == owner.name:
                self.add(name, "function", start, end)
            elif self.at(name - 1) in ("~", "operator"):
                self.declared.add(name)
            elif name > i:
                self.add(name, "method", start, end)
            return end + 1
        if name == i:
            return self.skip(k)
        if x == "{":
            end = self.close(k)
            if self.at(end + 1) == "=":
                end = self.find(end + 1, ";", limit)
        else:
            end = self.find(k, ";", limit)
            while self.at(end) not in (";", "") and end < limit:
                end = self.find(self.skip(end), ";", limit)
        self.add(name, "variable", start, end)
        return end + 1


class Rust(Scan):
    language = "rust"
    VALUE_BEFORE = ("=",)
    inside = ""

    def declaration(self, i, limit, owner):
        x, name = self.at(i), i + 1
        if x == "#" and self.at(i + 1) in ("[", "!"):
            return self.close(i + 1) + 1 if self.at(i + 1) == "[" else i + 2
        start = i
        while self.at(start - 1) in ("pub", "const", "async", "unsafe", "extern", ")") and start > 0:
            start = self.t[start - 1].pair if self.at(start - 1) == ")" and self.t[start - 1].pair >= 0 and self.at(self.t[start - 1].pair - 1) == "pub" else start - 1
            if self.at(start) == ")":
                start += 1
                break
        if x in ("struct", "enum", "trait", "union") and self.kind(name) == "ident":
            lo, end = self.block(name, limit)
            s = self.add(name, {"enum": "enum", "trait": "interface"}.get(x, "class"), start, end)
            if x == "trait":
                before, self.inside = self.inside, "type"
                self.members(lo + 1, end, s)
                self.inside = before
            return end + 1
        if x == "impl":
            lo, end = self.block(i + 1, limit)
            before, self.inside = self.inside, "type"
            self.members(lo + 1, end, None)
            self.inside = before
            return end + 1
        if x == "mod" and self.kind(name) == "ident":
            lo, end = self.block(name, limit)
            s = self.add(name, "namespace", start, end)
            if self.at(lo) == "{":
                before, self.inside = self.inside, ""
                self.members(lo + 1, end, s)
                self.inside = before
            return end + 1
        if x == "fn" and self.kind(name) == "ident":
            lo, end = self.block(name, limit)
            self.add(name, "method" if self.inside else "function", start, end)
            return end + 1
        if x == "type" and self.kind(name) == "ident" and not self.inside:
            end = self.find(name, ";", limit)
            self.add(name, "type_alias", start, end)
            return end + 1
        if x in ("const", "static") and not self.inside and self.at(i + 1) not in ("fn", "unsafe", "async", "extern"):
            name += self.at(name) == "mut"
            end = self.find(name, ";", limit)
            if self.kind(name) == "ident":
                self.add(name, "variable", start, end)
            return end + 1
        if x == "macro_rules" and self.at(i + 1) == "!":
            lo = i + 3
            end = self.close(lo) if self.at(lo) in PAIRS else lo
            self.add(i + 2, "function", start, end)
            return end + 1
        if x == "use":
            end = self.find(i, ";", limit)
            while self.at(end) not in (";", "") and end < limit:
                end = self.find(end + 1, ";", limit)
            return end + 1
        return self.skip(i)

    def extra_calls(self):
        return [(x.text, x.line) for i, x in enumerate(self.t) if x.kind == "ident" and self.at(i + 1) == "!" and self.at(i + 2) in PAIRS and x.text != "macro_rules"]


class Swift(Scan):
    language = "swift"
    VALUE_BEFORE = ("=",)
    MODIFIERS = frozenset("public private internal open fileprivate static final override mutating nonmutating class indirect lazy weak unowned required convenience dynamic nonisolated async".split())

    def declaration(self, i, limit, owner):
        start = i
        while self.at(i) in self.MODIFIERS and self.kind(i + 1) == "ident":
            if self.at(i) == "class" and self.at(i + 1) not in ("func", "var", "let", *self.MODIFIERS):
                break
            i += 1
        x, name = self.at(i), i + 1
        if x == "import":
            k = i + 1
            if self.at(k) in ("class", "struct", "enum", "protocol", "func", "var", "let", "typealias"):
                k += 1
            end = k
            while self.at(end + 1) == "." and self.kind(end + 2) == "ident":
                end += 2
            self.out.imports.append(("".join(self.at(j) for j in range(k, end + 1)), "", self.line(i)))
            return end + 1
        if x in ("class", "struct", "actor", "enum", "extension", "protocol") and self.kind(name) == "ident":
            lo, end = self.block(name, limit)
            s = self.add(name, {"enum": "enum", "extension": "namespace", "protocol": "interface"}.get(x, "class"), start, end)
            if self.at(lo) == "{":
                self.members(lo + 1, end, s)
            return end + 1
        if x == "typealias":
            end = self.statement_end(name, limit)
            self.add(name, "type_alias", start, end)
            return end + 1
        if x == "func" or x == "init" and owner is not None and self.at(i + 1) in ("(", "?", "<"):
            name = i + 1 if x == "func" else i
            k = self.find(name + 1, "{", min(limit, self.statement_end(name, limit) + 2))
            end = self.close(k) if self.at(k) == "{" else self.statement_end(name, limit)
            self.add(name, "method" if owner is not None else "function", start, end)
            return end + 1
        if x in ("var", "let") and owner is None and self.kind(name) == "ident":
            end = self.statement_end(name, limit)
            self.add(name, "variable", start, end)
            return end + 1
        return self.skip(i)


PARSERS = {scan.language: (lambda text, scan=scan: scan(text).run()) for scan in (Go, JavaScript, TypeScript, Tsx, CSharp, Rust, Swift)}
