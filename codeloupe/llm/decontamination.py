"""Benchmark decontamination with DataFrame and SQL functions only.

The windows of the benchmark are 10 consecutive words of an item; a shorter item is one window. What
travels with the scan of the training texts is a hash set: a Bloom filter of the hashes of the
windows' blocks of five words (of whole windows, for shorter ones). A text is hashed at every fifth
word, since the first such block in a window of ten is whole in it, and only the windows around a
block that the filter knows are built as strings. These are joined with the benchmark's windows,
equal strings only, so the filter decides nothing by itself.

The filter is used up to ``max_keys`` hashes (some four bytes each); beyond that the block hashes are
joined as eight-byte numbers. The benchmark's windows are broadcast up to ``max_windows`` and
``MAX_BYTES``; beyond that the join is shuffled, of the windows left by the filter. All ways give the
same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloupe.llm.common import checkpointed, columns, packed, unpacked

WINDOW = 10
#: Largest number and size of distinct benchmark windows that are broadcast.
MAX_WINDOWS, MAX_BYTES = 200_000, 32 << 20
#: Largest number of block hashes that travel as a Bloom filter.
MAX_KEYS = 500_000
#: Bits of the filter for each hash, seven in a byte: one block in some 1,500 passes by chance.
KEY_BITS = 32
#: Largest number of contaminated texts' hashes (64 bytes each) that are broadcast.
MAX_TEXTS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything in ASCII that is no digit or letter, once A-Z are lower-cased.
BREAK = r"[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: str) -> str:
    """SQL: the array of a text column's words; null has none."""
    plain = f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"
    return f"filter(split({plain}, '{BREAK}'), w -> w <> '')"


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``item_id, size, gram``: the distinct windows of each item as space-joined words."""
    items = computed(columns(benchmark, item_id="string", text="string"), "__w", words("text")).where("size(__w) > 0")
    spans = items.select("item_id", "__w", F.expr(f"least(size(__w), {window})").alias("size"), F.expr(f"explode(sequence(1, greatest(size(__w) - {window - 1}, 1)))").alias("at"))
    return spans.select("item_id", "size", F.expr("array_join(slice(__w, at, size), ' ')").alias("gram")).distinct()


def computed(df: DataFrame, name: str, sql: str | Column) -> DataFrame:
    """``df`` with a column that is computed once a row, whatever is built on it.

    A plain projection would be merged into later projections and filters, and one that is merged
    into a lambda runs again for each element. A one-element generator stops that.
    """
    return df.select("*", F.explode(F.array(F.expr(sql) if isinstance(sql, str) else sql)).alias(name))


def key_at(size: int, block: int) -> str:
    """SQL: the hash of the ``block`` words of ``__w`` from ``i`` on, for windows of ``size`` words."""
    return f"xxhash64({size}, " + ", ".join(f"__w[i + {k}]" for k in range(block)) + ")"


def block_of(size: int, window: int) -> int:
    """Words that are hashed together, at every such step; windows shorter than others are hashed whole, at every word."""
    return (size + 1) // 2 if size == window else size


def slots(key: Column, bits: int) -> list[Column]:
    """Three places of a key in a filter of so many bits."""
    return [F.pmod(x, F.lit(bits)) for x in (key, F.shiftright(key, 21), F.shiftrightunsigned(key, 42) * 2654435761)]


def bloom(keys: DataFrame, bits: int) -> bytes:
    """The filter of ``keys`` (``key``), with seven bits in a byte, so that every byte is a character."""
    at = keys.select(F.explode(F.array(*slots(F.col("key"), bits))).alias("at"))
    filled = at.groupBy(F.expr("at div 7").alias("place")).agg(F.bit_or(F.expr("shiftleft(1, cast(at % 7 AS int))")).alias("value")).collect()
    table = bytearray(-(-bits // 7))
    for place, value in filled:
        table[place] = value
    return bytes(table)


def in_bloom(key: Column, table: Column, bits: int) -> Column:
    known = F.lit(True)
    for at in slots(key, bits):
        byte = F.ascii(F.substring(table, F.expr("1").cast("int") + F.floor(at / 7).cast("int"), F.lit(1)).cast("string"))
        known = known & (F.getbit(byte, (at % 7).cast("int")) == 1)
    return known


class Windows:
    """The benchmark's windows, written once: ``grams`` (``item_id, size, gram, gid``) and ``distinct`` (``size, gram, gid``)."""

    def __init__(self, benchmark: DataFrame, window: int, max_windows: int, max_keys: int):
        self.window = window
        grams = checkpointed(benchmark_windows(benchmark, window))
        self.distinct = checkpointed(grams.select("size", "gram").distinct().withColumn("gid", F.monotonically_increasing_id()))
        self.grams = grams.join(self.distinct, ["size", "gram"])
        n, size = self.distinct.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("gram")), F.lit(0))).collect()[0]
        self.small = n <= max_windows and size <= MAX_BYTES
        self.sizes = [size for (size,) in self.distinct.select("size").distinct().orderBy("size").collect()]  # ``window`` at most
        found = []
        every = computed(self.distinct, "__w", "split(gram, ' ')")
        for size in self.sizes:
            block = block_of(size, window)
            found.append(every.where(F.col("size") == size).select(F.expr(f"explode(transform(sequence(0, {size - block}), i -> {key_at(size, block)}))").alias("key")))
        self.keys = None
        for one in found:
            self.keys = one if self.keys is None else self.keys.unionByName(one)
        if self.keys is not None:
            self.keys = checkpointed(self.keys.distinct())
            n = self.keys.count()
            self.bits = max(7 * 64, n * KEY_BITS)
            self.table = bloom(self.keys, self.bits) if n <= max_keys else None

    def broadcast(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.small else df

    def candidates(self, tokens: DataFrame) -> DataFrame:
        """``tokens``, rows with ``__w`` and a unique ``__rid``, with ``__c``: ``array<struct<at, size, gram>>`` of windows that may be the benchmark's."""
        if not self.sizes:
            return tokens.withColumn("__c", F.expr("cast(array() AS array<struct<at: int, size: int, gram: string>>)"))
        if self.table is not None:
            table, parts = F.lit(self.table), []
            for size in self.sizes:
                block = block_of(size, self.window)
                step = block if size == self.window else 1
                hashed = F.expr(f"CASE WHEN size(__w) >= {size} THEN transform(sequence(0, size(__w) - {block}, {step}), i -> struct({size} AS size, i AS i, {key_at(size, block)} AS key)) ELSE array() END")
                parts.append(F.filter(hashed, lambda x: in_bloom(x["key"], table, self.bits)))
            return self._built(computed(tokens, "__k", F.concat(*parts)))
        rows = []
        for size in self.sizes:
            block = block_of(size, self.window)
            step = block if size == self.window else 1
            own = tokens.where(f"size(__w) >= {size}").select("__rid", F.lit(size).alias("size"), F.expr(f"posexplode(transform(sequence(0, size(__w) - {block}, {step}), i -> {key_at(size, block)}))").alias("i", "key"))
            rows.append(own.withColumn("i", F.col("i") * step))
        every = rows[0]
        for other in rows[1:]:
            every = every.unionByName(other)
        known = every.join(self.keys, "key", "left_semi").groupBy("__rid").agg(F.collect_list(F.struct("size", "i")).alias("__k"))
        return self._built(tokens.join(known, "__rid", "left").withColumn("__k", F.coalesce("__k", F.expr("cast(array() AS array<struct<size: int, i: int>>)"))))

    def _built(self, marked: DataFrame) -> DataFrame:
        """The windows, as strings, that a known block (``__k``) is the first whole one of."""
        back = block_of(self.window, self.window) - 1
        starts = f"CASE WHEN k.size = {self.window} THEN sequence(greatest(k.i - {back}, 0), k.i) ELSE array(k.i) END"
        built = f"flatten(transform(__k, k -> transform(filter({starts}, p -> p + k.size <= size(__w)), p -> struct(p + 1 AS at, k.size AS size, array_join(slice(__w, p + 1, k.size), ' ') AS gram))))"
        return computed(marked, "__c", built).drop("__k")


#: Words covered by sorted hits: a hit adds the words past the last one's end.
COVERED = """aggregate(hits, struct(0 AS upto, 0L AS n),
    (s, h) -> struct(greatest(s.upto, h.at + h.size - 1) AS upto, s.n + greatest(h.at + h.size - 1 - greatest(s.upto, h.at - 1), 0) AS n), s -> s.n)"""


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS, max_keys: int = MAX_KEYS) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    Null and wordless texts have no words and no hits; items without words and repeated items add
    nothing; a null item_id counts as no item. ``items_sha256`` of no items is that of ''. Repeated
    rows and ties of doc_id give a result each, empty tables none or no hits; other columns aren't
    read. Texts of any length are scanned whole.
    """
    windows = Windows(benchmark, window, max_windows, max_keys)
    own = columns(docs, doc_id="long", text="string").withColumn("__rid", F.monotonically_increasing_id())
    if windows.sizes and windows.table is None:
        own = checkpointed(own)  # the ids are used by both sides of a join
    found = windows.candidates(computed(own, "__w", words("text")))
    slim = found.select("__rid", "doc_id", F.expr("cast(size(__w) AS bigint)").alias("n_words"), F.explode_outer("__c").alias("c")).select("__rid", "doc_id", "n_words", "c.at", "c.size", "c.gram")
    known = slim.join(windows.broadcast(windows.distinct), ["size", "gram"], "left")
    hit = F.when(F.col("gid").isNotNull(), F.struct("at", "size"))
    per_doc = known.groupBy("__rid", "doc_id", "n_words").agg(F.array_sort(F.collect_list(hit)).alias("hits"), F.collect_set("gid").alias("gids"))
    counted = per_doc.select("__rid", "doc_id", "n_words", F.expr(COVERED).alias("n_hit"), F.explode_outer("gids").alias("gid"))
    items = counted.join(windows.broadcast(windows.grams.select("gid", "item_id")), "gid", "left")
    listed = items.groupBy("__rid", "doc_id", "n_words", "n_hit").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    return listed.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.expr("cast(size(items) AS bigint)").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", window: int = WINDOW, max_windows: int = MAX_WINDOWS, max_keys: int = MAX_KEYS) -> DataFrame:
    """``docs`` without its contamination; the same columns.

    ``remove="documents"`` drops every row with a hit. ``remove="spans"`` keeps all rows and cuts
    each maximal run of hit words out of its text, with the separators inside the run; the text
    around it stays as it is. Rows without a hit pass unchanged, and so do null and empty texts.
    Equal texts fare alike, whatever their doc_ids; an empty table stays empty, and without any item
    nothing goes. Other columns pass through, whatever their names.

    Hits are found in one scan and kept by the texts' SHA-256; a second scan takes them out. Only the
    hashes are broadcast, ``MAX_TEXTS`` of them at most; beyond that the join is shuffled.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove must be 'documents' or 'spans', not {remove!r}")
    windows = Windows(benchmark, window, max_windows, max_keys)
    own = columns(docs, text="string").where("text is not null")
    if windows.sizes and windows.table is None:
        own = own.distinct()
    own = own.withColumn("__rid", F.sha2("text", 256))
    suspects = windows.candidates(computed(own, "__w", words("text"))).select("__rid", F.explode("__c").alias("c")).select("__rid", "c.at", "c.size", "c.gram")
    hits = suspects.join(windows.broadcast(windows.distinct), ["size", "gram"]).select("__rid", "at", "size").distinct()
    if remove == "documents":
        hits = hits.select("__rid").distinct()
    else:
        runs = """aggregate(hits, cast(array() AS array<struct<a: int, b: int>>), (s, h) ->
            CASE WHEN size(s) > 0 AND h.at <= s[size(s) - 1].b + 1
                 THEN concat(slice(s, 1, size(s) - 1), array(struct(s[size(s) - 1].a AS a, greatest(s[size(s) - 1].b, h.at + h.size - 1) AS b)))
                 ELSE concat(s, array(struct(h.at AS a, h.at + h.size - 1 AS b))) END)"""
        hits = hits.groupBy("__rid").agg(F.array_sort(F.collect_list(F.struct("at", "size"))).alias("hits")).select("__rid", F.expr(runs).alias("runs"))
    hits = checkpointed(hits)
    known = F.broadcast(hits) if hits.limit(MAX_TEXTS + 1).count() <= MAX_TEXTS else hits
    rows = packed(docs).withColumn("__rid", F.sha2(F.col("row")["text"].cast("string"), 256))
    if remove == "documents":
        return unpacked(rows.join(known, "__rid", "left_anti"), docs.columns)
    # Pieces alternate: separator, word, separator, ..., so word k is piece 2k and cutting is by index.
    gaps = r"regexp_extract_all(row.text, '([\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*)([^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+|$)', 0)"
    cut = computed(rows.join(known, "__rid", "left"), "pieces", f"CASE WHEN runs IS NOT NULL THEN {gaps} END")
    kept = r"""array_join(transform(pieces, (p, i) -> CASE
        WHEN exists(runs, r -> i + 1 = r.a) THEN regexp_extract(p, '^[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*', 0)
        WHEN exists(runs, r -> i + 1 > r.a AND i + 1 <= r.b) THEN '' ELSE p END), '')"""
    return unpacked(cut, docs.columns, text=F.when(F.col("runs").isNotNull(), F.expr(kept)).otherwise(F.col("row")["text"]))
