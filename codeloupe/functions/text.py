"""Column expressions over identifiers and patterns; all run inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Where an identifier's case starts a new word: aB, 1B, and the last capital of ABc.
BOUNDARY = r"(?<=[\p{Ll}\p{Nd}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"


def ascii_lower(x: Column) -> Column:
    return F.translate(x, UPPER, LOWER)


def like(x: Column, pattern: str) -> Column:
    """``LIKE`` that ignores the case of ASCII letters and knows no escape character.

    ``%`` and ``_`` of the pattern are wildcards, wherever they come from.
    """
    folded = pattern.translate(str.maketrans(UPPER, LOWER)).replace("\\", "\\\\")
    return ascii_lower(x).like(folded)


def split_identifier(x: Column) -> Column:
    """The lower-cased words of an identifier: camel and Pascal case, acronyms, underscores. Digits don't split."""
    return F.filter(F.split(F.lower(F.regexp_replace(x, BOUNDARY, "_")), "_+"), lambda w: w != "")


def split_literal(x: Column) -> Column:
    """The words of a string literal: runs of letters and digits, lower-cased, of two characters or more."""
    return F.filter(F.split(F.lower(x), r"[^\p{L}\p{Nd}]+"), lambda w: F.length(w) >= 2)


def index_words(x: Column) -> Column:
    """The tokens that full-text search makes of a column: runs of letters and digits, Latin diacritics folded."""
    accents, plain = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
    return F.filter(F.split(F.translate(F.lower(x), accents, plain), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def split_name(name: str) -> list[str]:
    """``split_identifier`` of one string on the driver."""
    words, start = [], 0
    kind = [("u" if c.isupper() else "l" if c.islower() else "d" if c.isdigit() else "_" if c == "_" else "o") for c in name]
    for i in range(1, len(name) + 1):
        cut = i == len(name) or kind[i] == "_" or kind[i - 1] == "_" or kind[i] == "u" and kind[i - 1] in "ld" or i + 1 < len(name) and kind[i] == "u" and kind[i - 1] == "u" and kind[i + 1] == "l"
        if cut:
            words.append(name[start:i].strip("_").lower())
            start = i
    return [w for w in words if w]


def literal_words(text: str) -> list[str]:
    """``split_literal`` of one string on the driver."""
    return [w for w in re.split(r"[\W_]+", text.lower()) if len(w) >= 2]


def query_words(query: str) -> list[str]:
    """The distinct words of a search query, in order."""
    return list(dict.fromkeys(w for part in query.split() for w in split_name(part)))


def unexported(name: Column, path: Column) -> Column:
    """Whether a name is private by its first byte; never in Rust, whose names don't tell.

    The first UTF-8 byte is read as a character of its own: a-z count as lower case, and so do the
    lead bytes 0xDF to 0xFF but 0xF7, 0xAA, 0xB5 and 0xBA.
    """
    lead = F.substring(F.hex(F.encode(name, "UTF-8")), 1, 2)
    lower = lead.between("61", "7A") | (lead.between("DF", "FF") & (lead != "F7")) | lead.isin("AA", "B5", "BA")
    return F.when((name == "") | path.endswith(".rs"), False).otherwise(lower)


def repo_id(root: Column) -> Column:
    """A repository's id: its folder's name and eight digits of its path's SHA-256."""
    return F.concat(F.substring_index(root, "/", -1), F.lit("-"), F.substring(F.sha2(root, 256), 1, 8))


def line_slice(text: Column, start: Column, end: Column) -> Column:
    """Lines ``start`` to ``end`` of a text (from 1), each ended by one newline, without carriage returns."""
    lines = F.split(F.regexp_replace(text, r"\r(?=\n|\z)", ""), "\n")
    count = F.when(text.endswith("\n"), F.size(lines) - 1).otherwise(F.size(lines))
    taken = F.slice(lines, F.greatest(start, F.lit(1)), F.greatest(F.least(end, count) - F.greatest(start, F.lit(1)) + 1, F.lit(0)))
    return F.when(F.size(taken) == 0, "").otherwise(F.concat(F.array_join(taken, "\n"), F.lit("\n")))
