"""Risk scores of impacts as column expressions, and their aggregate."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloupe.model import BREAK_WEIGHTS, CROSS, MANUAL, NO_RUNTIME, REASON_WEIGHTS


@dataclass(frozen=True)
class Weights:
    reasons: dict[str, int] = field(default_factory=lambda: dict(REASON_WEIGHTS))
    breaks: dict[str, int] = field(default_factory=lambda: dict(BREAK_WEIGHTS))
    penalty_step: int = 4
    penalty_cap: int = 24
    cross_bonus: int = 12
    least_confidence: float = 0.35
    most_confidence: float = 0.98
    confidence_step: float = 0.08
    score_boost: float = 0.003

    def merged(self, **given) -> Weights:
        """These weights with the given ones in place; what is zero or empty keeps its default."""
        changes = {k: {**getattr(self, k), **v} if isinstance(v, dict) else v for k, v in given.items() if v}
        return replace(self, **changes)


def tier(score: Column) -> Column:
    return F.when(score >= 85, "critical").when(score >= 65, "high").when(score >= 35, "medium").otherwise("low")


def likelihood(score: Column) -> Column:
    return F.when(score >= 85, "very_likely").when(score >= 60, "likely").when(score >= 30, "possible").otherwise("unlikely")


def clamp(x: Column, least, most) -> Column:
    return F.greatest(F.least(x, F.lit(most)), F.lit(least))


def weighed(items: Column, weights: dict[str, int]) -> Column:
    """The sum of an array's weights; what has none, or none above zero, adds nothing."""
    positive = {k: v for k, v in weights.items() if v > 0}
    lookup = F.create_map(*(F.lit(x) for kv in positive.items() for x in kv)) if positive else None
    return F.aggregate(items, F.lit(0), lambda n, x: n + F.coalesce(lookup[x], F.lit(0))) if lookup is not None else F.lit(0)


def score(impacts: DataFrame, weights: Weights | None = None, ordered: bool = True) -> DataFrame:
    """``impacts`` with ``risk_score, confidence, risk_tier, likelihood`` and an ``explanation``, riskiest first where ``ordered``."""
    w = weights or Weights()
    reasons, d = F.col("reasons"), F.col("distance")
    penalty = F.greatest((d - 1) * w.penalty_step, F.lit(0))
    penalty = F.when(d <= 1, 0).otherwise(F.least(penalty, F.lit(w.penalty_cap)) if w.penalty_cap > 0 else penalty)
    parts = impacts.withColumns({"__base": weighed(reasons, w.reasons), "__breaks": weighed(F.col("breaks"), w.breaks), "__penalty": penalty, "__bonus": F.when(F.array_contains(reasons, CROSS), w.cross_bonus).otherwise(0)})
    parts = parts.withColumn("__raw", F.col("__base") + F.col("__breaks") + F.col("__bonus") - F.col("__penalty")).withColumn("risk_score", clamp(F.col("__raw"), 0, 100))
    confidence = w.most_confidence - F.greatest(d - 1, F.lit(0)) * w.confidence_step + F.col("risk_score") * w.score_boost
    confidence = confidence - F.when(F.array_contains(reasons, NO_RUNTIME), 0.1).otherwise(0.0) - F.when(F.array_contains(reasons, MANUAL), 0.05).otherwise(0.0)
    parts = parts.withColumn("confidence", clamp(confidence, w.least_confidence, w.most_confidence)).withColumn("risk_tier", tier(F.col("risk_score"))).withColumn("likelihood", likelihood(F.col("risk_score")))
    positive = {k: v for k, v in w.reasons.items() if v > 0}
    by_reason = F.map_filter(F.create_map(*(F.lit(x) for kv in positive.items() for x in kv)), lambda k, v: F.array_contains(reasons, k))
    explanation = F.struct(
        by_reason.alias("base_by_reasons"), F.col("__breaks").alias("break_type_weight_sum"), F.col("__penalty").alias("distance_penalty"), F.col("__bonus").alias("cross_repo_bonus"),
        F.col("__raw").alias("raw_score"), F.col("risk_score").alias("final_score"), "confidence", "risk_tier",
    )
    found = parts.withColumn("explanation", explanation).drop("__base", "__breaks", "__penalty", "__bonus", "__raw")
    return found.orderBy(F.desc("risk_score"), F.desc("confidence"), "distance", "repo", "file", "symbol", "line") if ordered else found


def aggregate(scored: DataFrame) -> DataFrame:
    """One row, ``risk_score, confidence, risk_tier``: the worst item at 60 %, the mean by 1/distance at 40 %."""
    weight = F.when(F.col("distance") > 1, 1.0 / F.col("distance")).otherwise(1.0) * F.col("n")
    # Counted by what the sums are of, so that items aren't sorted first; there are few such values.
    counted = scored.groupBy("risk_score", "distance", "confidence").agg(F.count("*").alias("n"))
    sums = counted.agg(F.max("risk_score").alias("top"), F.sum(F.col("risk_score") * weight).alias("risk"), F.sum(weight).alias("weight"), (F.sum(F.col("confidence") * F.col("n")) / F.sum("n")).alias("confidence"))
    some = F.col("top").isNotNull()
    mean = clamp(F.floor(F.col("risk") / F.col("weight") + 0.5), 0, 100)
    whole = F.when(some, F.floor((clamp(F.col("top"), 0, 100) * 60 + mean * 40) / 100)).otherwise(0).cast("int")
    return sums.select(whole.alias("risk_score"), F.when(some, clamp(F.col("confidence"), 0.0, 1.0)).otherwise(0.0).alias("confidence"), tier(whole).alias("risk_tier"))


def boundaries(scored: DataFrame) -> DataFrame:
    """High risks that cross repositories: ``kind, source_repo, target_repo, risk_score``."""
    found = scored.filter((F.col("risk_score") >= 65) & F.array_contains("reasons", CROSS))
    return found.select(F.lit("shared_type").alias("kind"), F.lit("unknown").alias("source_repo"), F.col("repo").alias("target_repo"), "risk_score")
