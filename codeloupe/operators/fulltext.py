"""Full-text search of symbols: a stored index, a query grammar and BM25 ranks.

Indexing stores each symbol's ``words`` by column and their number, and ``postings``: every token of
a symbol once, sorted by token. A query is phrases joined by AND, OR, NOT. The postings of the
phrases' first tokens, a filter that is pushed to the scan, name the symbols in which a phrase can
stand; only those are read and counted. The statistics are those of the whole index, whatever
filters come after: lengths are one stored number a symbol, and a phrase's symbols are all among
those that were read. Without an index the same is done by tokenising the symbols.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloupe.functions.text import index_words, query_words, split_identifier

COLUMNS = ("name", "type", "parent", "file_path", "name_tokens", "body_tokens")
K1, B = 1.2, 0.75
#: Any of these makes a query one of the full grammar.
POWER = set('*":^')


@dataclass(frozen=True)
class Phrase:
    """Consecutive tokens in one of some columns; the last may be a prefix, the first tied to a column's start."""

    tokens: tuple[str, ...]
    columns: tuple[str, ...] = COLUMNS
    prefix: bool = False
    initial: bool = False


@dataclass(frozen=True)
class Node:
    """A query: a phrase, or others joined by ``and``, ``or``, ``not`` or ``near``."""

    kind: str
    phrase: Phrase | None = None
    parts: tuple[Node, ...] = ()
    distance: int = 10

    def phrases(self) -> list[Phrase]:
        return [self.phrase] if self.phrase else [p for x in self.parts for p in x.phrases()]


TOKEN = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([(){}:^+*,-])|([^\s"(){}:^+*,-]+))')


@dataclass
class Grammar:
    """Recursive descent over the query text. Precedence: NOT, AND (also implied), OR."""

    text: str
    items: list[tuple[str, str]] = field(default_factory=list)
    at: int = 0

    def __post_init__(self) -> None:
        where = 0
        while where < len(self.text.rstrip()):
            m = TOKEN.match(self.text, where)
            if not m:
                raise ValueError(f"cannot read the query at {self.text[where:]!r}")
            kind = "string" if m[1] is not None else "sign" if m[2] else "word"
            self.items.append((kind, m[1].replace('""', '"') if m[1] is not None else m[2] or m[3]))
            where = m.end()

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.items[self.at + ahead] if self.at + ahead < len(self.items) else ("end", "")

    def take(self, kind: str, value: str | None = None) -> str | None:
        k, v = self.peek()
        if k == kind and value in (None, v):
            self.at += 1
            return v
        return None

    def parse(self) -> Node:
        found = self.disjunction(COLUMNS)
        if self.peek()[0] != "end":
            raise ValueError(f"cannot read the query at {self.peek()[1]!r}")
        return found

    def joined(self, kind: str, parts: list[Node]) -> Node:
        return parts[0] if len(parts) == 1 else Node(kind, parts=tuple(parts))

    def disjunction(self, columns: tuple[str, ...]) -> Node:
        parts = [self.conjunction(columns)]
        while self.take("word", "OR"):
            parts.append(self.conjunction(columns))
        return self.joined("or", parts)

    def conjunction(self, columns: tuple[str, ...]) -> Node:
        parts = [self.negation(columns)]
        while True:
            if self.take("word", "AND") or self.peek()[0] in ("string", "word") and self.peek() not in (("word", "OR"), ("word", "NOT")) or self.peek() in (("sign", "("), ("sign", "{"), ("sign", "^"), ("sign", "-")):
                parts.append(self.negation(columns))
            else:
                return self.joined("and", parts)

    def negation(self, columns: tuple[str, ...]) -> Node:
        found = self.primary(columns)
        while self.take("word", "NOT"):
            found = Node("not", parts=(found, self.primary(columns)))
        return found

    def filtered(self, columns: tuple[str, ...]) -> tuple[str, ...] | None:
        """The columns of a column filter in front, if one is there."""
        start, out = self.at, self.take("sign", "-") is not None
        names = None
        if self.take("sign", "{"):
            names = []
            while (name := self.take("word")) is not None:
                names.append(name)
            if not self.take("sign", "}"):
                raise ValueError("a column list is not closed")
        elif self.peek()[0] in ("word", "string") and self.peek(1) == ("sign", ":"):
            names = [self.take(self.peek()[0])]
        if names is None or not self.take("sign", ":"):
            self.at = start
            return None
        names = [{"body_snippet": "body_tokens"}.get(n.lower(), n.lower()) for n in names]
        if unknown := [n for n in names if n not in COLUMNS]:
            raise ValueError(f"no such column: {unknown[0]}")
        return tuple(c for c in columns if (c in names) != out)

    def primary(self, columns: tuple[str, ...]) -> Node:
        chosen = self.filtered(columns)
        if chosen is not None:
            return self.primary(chosen)
        if self.take("sign", "("):
            found = self.disjunction(columns)
            if not self.take("sign", ")"):
                raise ValueError("a bracket is not closed")
            return found
        if self.peek() == ("word", "NEAR") and self.peek(1) == ("sign", "("):
            self.at += 2
            parts, distance = [], 10
            while self.peek() not in (("sign", ")"), ("end", "")):
                if self.take("sign", ","):
                    distance = int(self.take("word") or 10)
                else:
                    parts.append(Node("phrase", self.phrase(columns)))
            if not self.take("sign", ")"):
                raise ValueError("NEAR is not closed")
            return Node("near", parts=tuple(parts), distance=distance) if len(parts) > 1 else parts[0]
        return Node("phrase", self.phrase(columns))

    def phrase(self, columns: tuple[str, ...]) -> Phrase:
        initial = self.take("sign", "^") is not None
        texts = []
        while True:
            kind, value = self.peek()
            if kind not in ("string", "word"):
                raise ValueError(f"cannot read the query at {value!r}")
            self.at += 1
            texts.append(value)
            if not self.take("sign", "+"):
                break
        prefix = self.take("sign", "*") is not None
        return Phrase(tuple(w for t in texts for w in plain_words(t)), columns, prefix, initial)


def plain_words(text: str) -> list[str]:
    """``index_words`` of one string on the driver."""
    folded = text.lower().translate(str.maketrans("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"))
    return [w for w in re.split(r"[\W_]+", folded) if w]


def parse_query(text: str) -> Node | None:
    """The query of a search text; None if it holds no token.

    Text without a sign of the grammar is plain: each of its identifiers' words must begin a word of
    the name or the body.
    """
    if POWER & set(text):
        return Grammar(text).parse()
    parts = []
    for word in query_words(text):
        tokens = tuple(plain_words(word))
        if tokens:
            parts.append(Node("or", parts=tuple(Node("phrase", Phrase(tokens, (c,), prefix=True)) for c in ("name_tokens", "body_tokens"))))
    return (Node("and", parts=tuple(parts)) if len(parts) > 1 else parts[0]) if parts else None


def with_id(symbols: DataFrame) -> DataFrame:
    """Symbols with ``symbol_id``, their key's hash where they have none."""
    if "symbol_id" in symbols.columns:
        return symbols
    key = [c for c in ("repo_id", "file_path", "name", "type", "start_line") if c in symbols.columns]
    return symbols.withColumn("symbol_id", F.xxhash64(*key))


def tokenised(symbols: DataFrame) -> DataFrame:
    """Symbols with ``__words``: an array of tokens for each of ``COLUMNS``; stored ones where there are any."""
    if "words" in symbols.columns:
        return symbols.withColumn("__words", F.col("words"))
    if "name_tokens" not in symbols.columns:
        symbols = symbols.withColumn("name_tokens", split_identifier(F.col("name")))

    def text(c: str) -> Column:
        if c not in symbols.columns:
            return F.lit("")
        kind = symbols.schema[c].dataType.simpleString()
        return F.array_join(c, " ") if kind.startswith("array") else F.coalesce(F.col(c), F.lit(""))

    # A one-element generator: a plain projection would be merged into the lambdas below, and run for each place of a text.
    return symbols.withColumn("__words", F.explode(F.array(F.array(*(index_words(text(c)) for c in COLUMNS)))))


def with_words(symbols: DataFrame) -> DataFrame:
    """Symbols with what the index stores of them: ``symbol_id, words, n_words``."""
    rows = tokenised(with_id(symbols.drop("words", "n_words"))).withColumnRenamed("__words", "words")
    return rows.withColumn("n_words", F.aggregate("words", F.lit(0), lambda n, ws: n + F.size(ws)))


def candidates(postings: DataFrame, phrases: list[Phrase]) -> DataFrame:
    """``symbol_id`` of the symbols that hold the first token of one of the phrases."""
    found = F.lit(False)
    for p in phrases:
        if p.tokens:
            found = found | (F.col("token").startswith(p.tokens[0]) if p.prefix and len(p.tokens) == 1 else F.col("token") == p.tokens[0])
    return postings.filter(found).select("symbol_id").distinct()


def postings(symbols: DataFrame) -> DataFrame:
    """``symbol_id, col, token, place`` of every token; ``col`` is a number into ``COLUMNS``."""
    words = tokenised(with_id(symbols)).select("symbol_id", F.posexplode("__words").alias("col", "ws"))
    return words.select("symbol_id", "col", F.posexplode("ws").alias("place", "token"))


def phrase_count(p: Phrase) -> Column:
    """How often a phrase occurs in the ``__words`` of a row."""
    n = len(p.tokens)

    def here(ws: Column, i: Column) -> Column:
        tests = [F.get(ws, i + k) == t if k < n - 1 or not p.prefix else F.get(ws, i + k).startswith(t) for k, t in enumerate(p.tokens)]
        found = tests[0]
        for t in tests[1:]:
            found = found & t
        return found

    def count(ws: Column) -> Column:
        places = F.sequence(F.lit(0), F.lit(0)) if p.initial else F.sequence(F.lit(0), F.greatest(F.size(ws) - n, F.lit(0)))
        return F.when(F.size(ws) < n, 0).otherwise(F.size(F.filter(places, lambda i: here(ws, i))))

    counts = [count(F.col("__words")[COLUMNS.index(c)]) for c in p.columns] if n else []
    return sum(counts[1:], counts[0]) if counts else F.lit(0)


def near(node: Node) -> Column:
    """Whether a column holds one of each phrase, each with ``distance`` tokens at most between it and the first one."""
    found = F.lit(False)
    for c in COLUMNS:
        ws = F.col("__words")[COLUMNS.index(c)]
        phrases = [x.phrase for x in node.parts]
        if any(c not in p.columns for p in phrases):
            continue

        def places(p: Phrase, ws: Column = ws) -> Column:  # bound now: the loop goes on
            n = len(p.tokens)
            every_place = F.sequence(F.lit(0), F.greatest(F.size(ws) - 1, F.lit(0)))

            def here(i: Column) -> Column:
                tests = [F.get(ws, i + k) == t if k < n - 1 or not p.prefix else F.coalesce(F.get(ws, i + k), F.lit("")).startswith(t) for k, t in enumerate(p.tokens)]
                out = tests[0]
                for t in tests[1:]:
                    out = out & t
                return F.coalesce(out, F.lit(False))

            return F.filter(every_place, here)

        lengths = [len(p.tokens) for p in phrases]
        first, *others = [places(p) for p in phrases]

        def beside(i: Column, k: int, others: list[Column] = others, lengths: list[int] = lengths) -> Column:
            gap = lambda j: F.greatest(j - i - lengths[0], i - j - lengths[k + 1])
            return F.exists(others[k], lambda j: gap(j) <= node.distance)

        def all_beside(i: Column) -> Column:
            return _all([beside(i, k) for k in range(len(others))])

        close = F.exists(first, all_beside)
        found = found | close
    return found


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def matches(node: Node, counts: dict[Phrase, Column]) -> Column:
    if node.phrase:
        return counts[node.phrase] > 0
    parts = [matches(x, counts) for x in node.parts]
    if node.kind == "or":
        out = parts[0]
        for t in parts[1:]:
            out = out | t
        return out
    if node.kind == "not":
        return parts[0] & ~parts[1]
    return _all(parts) & (near(node) if node.kind == "near" else F.lit(True))


def ranked(symbols: DataFrame, query: str, by: tuple[str, ...] = (), index: DataFrame | None = None) -> DataFrame:
    """Matching symbols with ``rank``, BM25 negated: the smaller, the better.

    ``index`` holds the stored postings of ``symbols``: then only symbols with a query's tokens are
    read whole. One pass counts phrases for each symbol; the collection's statistics are one small
    aggregate (for each value of ``by``), joined back by broadcast of one row.
    """
    node = parse_query(query)
    if node is None:
        return tokenised(with_id(symbols)).withColumn("rank", F.lit(0.0)).filter(F.lit(False)).drop("__words")
    phrases = list(dict.fromkeys(node.phrases()))
    names = {p: F.col(f"__f{k}") for k, p in enumerate(phrases)}
    own = symbols if index is None else symbols.join(candidates(index, phrases), "symbol_id", "left_semi")
    counted = tokenised(with_id(own)).select("*", *(phrase_count(p).alias(f"__f{k}") for k, p in enumerate(phrases)), F.aggregate("__words", F.lit(0), lambda n, ws: n + F.size(ws)).alias("__d"))
    hits = [F.count_if(F.col(f"__f{k}") > 0).alias(f"__n{k}") for k in range(len(phrases))]
    size = [F.count("*").alias("__N"), F.avg("__d").alias("__avg")]
    if index is None:
        stats = counted.groupBy(*by).agg(*size, *hits)
    else:
        whole = symbols.select(*by, F.col("n_words").alias("__d")).groupBy(*by).agg(*size)
        found = counted.groupBy(*by).agg(*hits)
        stats = whole.join(found, list(by)) if by else whole.crossJoin(found)  # one row each
    joined = counted.filter(matches(node, names))
    joined = joined.join(stats, list(by)) if by else joined.crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for k in (phrases.index(p) for p in node.phrases()):  # a phrase that stands twice counts twice
        n, f = F.col(f"__n{k}"), F.col(f"__f{k}")
        idf = F.log((F.col("__N") - n + 0.5) / (n + 0.5))
        score = score + F.when(idf <= 0, 1e-6).otherwise(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("__d") / F.col("__avg")))
    extra = [c for c in joined.columns if c.startswith("__")]
    return joined.withColumn("rank", -score).drop(*extra)


def search_text(symbols: DataFrame, q, by: tuple[str, ...] = (), index: DataFrame | None = None) -> DataFrame:
    """Symbols that match ``q.fuzzy``, best first; the filters of ``q`` come after ranking."""
    from codeloupe.operators.search import SYMBOL_COLUMNS, every, narrowing

    found = every(narrowing(q), ranked(symbols, q.fuzzy, by, index)).select(*by, *SYMBOL_COLUMNS, "rank", "symbol_id")
    if by and q.limit:
        found = found.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy("rank", "file_path", "start_line", "symbol_id"))).filter(F.col("__n") <= q.limit).drop("__n")
    found = found.orderBy(*by, "rank", "file_path", "start_line", "symbol_id").drop("symbol_id")
    return found.limit(q.limit) if q.limit and not by else found
