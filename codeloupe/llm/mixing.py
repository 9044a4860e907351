"""Mixing sources to target weights by temperature.

A source's weight is its share of the tokens to the power ``a``, normalised. The exponent is
bisected between 1 (as they are) and 0 (all alike) until the weights reach a target entropy or some
source would be repeated more often than allowed, whichever binds first. A budget of tokens then
gives each source its own; a source is passed over in whole epochs, each in a permutation of its
own, and the last epoch ends where the budget is used up. The stream is cut into blocks by each
source's progress, so that every block holds all sources at their weights; inside a block rows are
permuted.

Words are counted once, into a table of one small row for each different document. The bisection
needs sums over the sources only: of few different totals they are taken on the driver, else by an
aggregation for each pass, so there may be any number of sources. Running totals come from two
levels: hashes split an epoch of a source into ``PIECES`` pieces whose totals are summed first, and
only inside a piece are rows in order. A source with a third of all rows is therefore thousands of
small windows, and a row that is repeated is one row with a count until the last step.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloupe.llm.common import checkpointed, packed, unpacked

SEED = 7
PIECE_BITS = 12
#: Different totals of sources that come to the driver, and sources that are broadcast, at most.
MAX_TOTALS = MAX_SOURCES = 100_000
BLOCK_TOKENS = 1_000_000
MAX_REPETITION = 2.0
#: Share of the greatest possible entropy.
TARGET_ENTROPY = 0.98
#: Halvings of the exponent's interval that one pass makes, and passes.
HALVINGS, PASSES = 4, 12
#: Copies of a row that one array holds while they are dealt out.
COPIES = 100_000


def tokens(text: str = "text") -> Column:
    """Words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Mix:
    """The exponent, and what a source's weight follows from: the largest total, and the sum of all powers of totals over it."""

    exponent: float
    most: int
    powers: float
    budget: float

    def weight(self, total: Column) -> Column:
        """A source's weight by its total; 0 without a token."""
        return F.when(total > 0, F.pow(total / F.lit(float(self.most or 1)), F.lit(self.exponent)) / F.lit(self.powers or 1.0)).otherwise(0.0)

    def weight_of(self, total: int) -> float:
        return (total / self.most) ** self.exponent / self.powers if total else 0.0


#: Of some exponents: the sums of powers of totals (over the largest), and of powers times logarithms.
Sums = Callable[[Sequence[float]], list[tuple[float, float]]]


def temper(n: int, least: int, most: int, sums: Sums, target_entropy: float = TARGET_ENTROPY, max_repetition: float = MAX_REPETITION, budget: float | None = None) -> Mix:
    """The mix of ``n`` sources with tokens, whose totals lie between ``least`` and ``most``.

    ``target_entropy`` is a share of the logarithm of ``n``. Without a ``budget`` it is the smallest
    that passes over every source once at least, so that no document is lost. With one, a source is
    allowed ``max_repetition`` passes too; where even the shares themselves need more, the exponent
    is 1 and the budget decides.
    """
    goal = target_entropy * math.log(n) if n > 1 else 0.0

    def enough(exponents: Sequence[float]) -> list[bool]:
        found = []
        for a, (powers, logs) in zip(exponents, sums(exponents)):
            entropy = math.log(powers) - a * logs / powers
            spread = (least / most) ** (a - 1)  # the passes of the smallest source to one of the largest
            passes = spread if budget is None else spread / (powers * most) * budget
            found.append(entropy >= goal or passes >= max_repetition)
        return found

    exponent = 1.0
    if n and not enough([1.0])[0]:
        low, high = 0.0, 1.0  # enough at low, or as far as one can go; not enough at high
        for _ in range(PASSES):
            steps = 1 << HALVINGS
            points = [low + (high - low) * k / steps for k in range(1, steps)]
            inside = sum(enough(points))  # enough up to there
            low, high = ([low, *points, high][inside + k] for k in (0, 1))
        exponent = high  # the allowed side of the repetition limit
    powers = sums([exponent])[0][0] if n else 0.0
    # Weights grow slower than totals, so the largest source needs the largest budget for one pass.
    return Mix(exponent, most, powers, budget if budget is not None else most * powers)


def sums_of(totals: np.ndarray, times: np.ndarray) -> Sums:
    """From totals on the driver, each standing for ``times`` sources."""
    share = totals / totals.max() if len(totals) else totals
    log = np.log(share)

    def sums(exponents: Sequence[float]) -> list[tuple[float, float]]:
        powers = [times * share**a for a in exponents]
        return [(float(p.sum()), float((p * log).sum())) for p in powers]

    return sums


def sums_in(sizes: DataFrame, most: int) -> Sums:
    """From a table of ``total`` and ``times``, by one aggregation a call."""
    share = F.col("total") / F.lit(float(most))

    def sums(exponents: Sequence[float]) -> list[tuple[float, float]]:
        powers = [F.col("times") * F.pow(share, F.lit(float(a))) for a in exponents]
        row = sizes.agg(*(F.sum(x) for p in powers for x in (p, p * F.log(share)))).collect()[0]
        return list(zip(row[::2], row[1::2]))

    return sums


def counted(docs: DataFrame) -> DataFrame:
    """``doc_id, source, n_tokens, text, copies`` of each different row, ``text`` as a hash; written once."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), tokens().alias("n_tokens"), F.xxhash64("text").alias("text"))
    return checkpointed(rows.groupBy("doc_id", "source", "n_tokens", "text").agg(F.count("*").alias("copies")))


def totals_of(rows: DataFrame) -> DataFrame:
    """``source, total`` of ``counted`` rows; written once."""
    return checkpointed(rows.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("total")))


def plan(totals: DataFrame, **options) -> Mix:
    """The mix of sources with these totals."""
    sizes = totals.where("total > 0").groupBy("total").agg(F.count("*").alias("times"))
    n, least, most = sizes.agg(F.coalesce(F.sum("times"), F.lit(0)), F.coalesce(F.min("total"), F.lit(0)), F.coalesce(F.max("total"), F.lit(0))).collect()[0]
    few = sizes.limit(MAX_TOTALS + 1).collect()
    if len(few) <= MAX_TOTALS:
        few.sort()
        return temper(n, least, most, sums_of(np.array([r.total for r in few], float), np.array([r.times for r in few], float)), **options)
    return temper(n, least, most, sums_in(checkpointed(sizes), most), **options)


def per_source(totals: DataFrame, mix: Mix) -> DataFrame:
    """``of, weight, budget, whole, passes`` of every source with a pass; broadcast if there are ``MAX_SOURCES`` at most.

    A source without any token has one whole pass.
    """
    weighed = totals.select(F.col("source").alias("of"), mix.weight(F.col("total")).alias("weight"), "total").withColumn("budget", F.col("weight") * F.lit(float(mix.budget)))
    many = F.coalesce(F.col("budget") / F.nullif("total", F.lit(0)), F.lit(1.0))
    known = checkpointed(weighed.select("of", "weight", "budget", F.floor(many + 1e-9).alias("whole"), F.ceil(many - 1e-9).alias("passes")).where("passes > 0"))
    return F.broadcast(known) if known.limit(MAX_SOURCES + 1).count() <= MAX_SOURCES else known


def drawn(rows: DataFrame, totals: DataFrame, mix: Mix, seed: int = SEED) -> DataFrame:
    """``counted`` rows as often as passes begin: with ``epoch, draw, at, budget, whole, weight``.

    ``at`` is the number of the source's tokens before a row's first copy.
    """
    passed = rows.join(per_source(totals, mix), F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("epoch", F.expr("explode(sequence(0, cast(passes as int) - 1))"))
    keyed = passed.withColumn("draw", F.xxhash64(F.lit(seed), "epoch", "doc_id", "text")).withColumn("piece", F.shiftright("draw", 64 - PIECE_BITS).cast("int")).withColumn("n", F.col("n_tokens") * F.col("copies"))
    pieces = keyed.groupBy("source", "epoch", "piece").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("source").orderBy("epoch", "piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select(F.col("source").alias("s"), F.col("epoch").alias("e"), F.col("piece").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("source", "epoch", "piece").orderBy("draw", "doc_id", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("inside", F.coalesce(F.sum("n").over(within), F.lit(0)))
    placed = placed.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("epoch") == F.col("e")) & (F.col("piece") == F.col("p")))
    return placed.withColumn("at", F.col("start") + F.col("inside"))


def draws(docs: DataFrame, seed: int = SEED, block_tokens: int = BLOCK_TOKENS, **options) -> DataFrame:
    """``doc_id, source, n_tokens, epoch, weight, at, block, draw`` of every time that a row is drawn.

    ``at`` is the number of the source's tokens before it, ``draw`` the order inside a block; sort
    by ``block, draw`` to read the mix. A row is drawn as long as its source's budget isn't used up
    when it starts, and in every whole pass. Rows without tokens (null, empty or blank texts) are
    drawn in whole passes; a source without any token has one. Null sources are a source, null
    doc_ids a doc_id. Rows that repeat a doc_id are told apart by their texts' hashes, exact repeats
    follow each other. An empty table gives no row; of other columns none is read.
    ``options`` are those of ``temper``.
    """
    rows = counted(docs)
    totals = totals_of(rows)
    mix = plan(totals, **options)
    placed = drawn(rows, totals, mix, seed)
    # Copies are dealt out in two steps, so that no array is long.
    parts = placed.withColumn("part", F.expr(f"explode(sequence(0L, (copies - 1) div {COPIES}))"))
    copies = parts.withColumn("copy", F.expr(f"explode(sequence(part * {COPIES}, least(copies, (part + 1) * {COPIES}) - 1))"))
    each = copies.withColumn("at", F.col("at") + F.col("copy") * F.col("n_tokens")).where((F.col("epoch") < F.col("whole")) | (F.col("at") < F.col("budget")))
    blocks = max(1, math.ceil(mix.budget / block_tokens))
    block = F.coalesce(F.least(F.floor(F.col("at") / F.nullif("budget", F.lit(0.0)) * blocks), F.lit(blocks - 1)), F.lit(0)).cast("long")
    return each.select("doc_id", "source", "n_tokens", F.col("epoch").cast("int").alias("epoch"), "weight", "at", block.alias("block"), "draw")


def mixture(docs: DataFrame, **options) -> DataFrame:
    """``draws`` under the name of the operator."""
    return draws(docs, **options)


def mixed(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """The rows of ``docs``, each as often as it is drawn, with their columns.

    What is drawn in the last pass of a source is a run of the pass's order, so one limit per
    source and epoch says it all: the texts are only read, never shuffled. Repeats of the last row
    of a run are all drawn. Nulls, ties, repeated rows and empty tables fare as in ``draws``; other
    columns pass through, whatever their names.
    """
    rows = counted(docs)
    totals = totals_of(rows)
    placed = drawn(rows, totals, plan(totals, **options), seed).where((F.col("epoch") < F.col("whole")) | (F.col("at") < F.col("budget")))
    place = lambda draw, doc_id, text: F.struct(draw.alias("draw"), F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63))).alias("id"), text.alias("text"))
    last = checkpointed(placed.groupBy(F.col("source").alias("of"), F.col("epoch").alias("pass")).agg(F.max(place(F.col("draw"), F.col("doc_id"), F.col("text"))).alias("last")))
    last = F.broadcast(last) if last.limit(MAX_SOURCES + 1).count() <= MAX_SOURCES else last
    row = F.col("row")
    met = packed(docs).join(last, row["source"].cast("string").eqNullSafe(F.col("of")))
    own = place(F.xxhash64(F.lit(seed), "pass", row["doc_id"].cast("long"), F.xxhash64(row["text"])), row["doc_id"], F.xxhash64(row["text"]))
    return unpacked(met.where(own <= F.col("last")), docs.columns)
