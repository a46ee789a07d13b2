"""Verdicts from passage scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits of the live verdict (fixed values).
WEAK, WEAK_SHARE, STRONG_REFUTER = 0.25, 0.6, 0.5
#: Decimals to which means of passages without an order are compared: the order in which they are summed does not decide a limit.
PLACES = 12


def rule_verdict(passages: DataFrame, claim: str, claims: DataFrame | None = None) -> DataFrame:
    """(claim, verdict, confidence) from passages(claim, support, refute); claims(claim) without any are (NEI, 0)."""
    m = passages.groupBy(claim).agg(F.max("support").alias("s"), F.max("refute").alias("r"))
    if claims is not None:
        m = claims.select(claim).distinct().join(m, claim, "left")
    s, r = F.col("s") >= 0.5, F.col("r") >= 0.5
    best = F.greatest("s", "r")
    verdict = F.when(s & r, "Conflicting").when(s, "Supported").when(r, "Refuted").otherwise("NEI")
    return m.select(claim, verdict.alias("verdict"), F.when(best.isNull(), 0.0).when(s | r, best).otherwise(1 - best).alias("confidence"))


def live_scored(passages: DataFrame, claim: str, order: str | None = None) -> DataFrame:
    """(claim, verdict, confidence) from passages(claim, support, refute, relevance): means weighted by relevance, at least 0.

    With an order, a claim's passages are summed one by one in it, as SQL sums a table that lies in that order: sums of doubles
    depend on it, and some means lie on a limit. A claim's rows then meet in one task, which sorts them and holds no list.
    """
    near = (lambda c: F.round(c, PLACES)) if order is None else (lambda c: c)
    if order is not None:
        passages = passages.repartition(claim).sortWithinPartitions(claim, order)
    w = F.greatest("relevance", F.lit(0.0))
    mean = lambda c: near(F.sum(w * F.col(c)) / F.when(F.sum(w) == 0, None).otherwise(F.sum(w)))
    m = passages.groupBy(claim).agg(mean("support").alias("s"), mean("refute").alias("r"), F.max("refute").alias("most"))
    s, r = F.col("s"), F.col("r")
    weak, strong, neutral = F.least("s", "r"), F.greatest("s", "r"), near(1 - s - r)
    sided = F.when(s < r, "Refuted").when(F.col("most") >= STRONG_REFUTER, "Conflicting").otherwise("Supported")
    verdict = F.when(s.isNull(), "NEI").when((weak >= WEAK) & (weak >= near(WEAK_SHARE * strong)), "Conflicting").when(strong > neutral, sided).otherwise("NEI")
    m = m.withColumn("verdict", verdict)
    v = F.col("verdict")
    sure = F.when(s.isNull(), 0.0).when(v == "Conflicting", F.least(F.lit(1.0), near(s + r))).when(v == "Supported", s).when(v == "Refuted", r).otherwise(neutral)
    return m.select(claim, "verdict", sure.alias("confidence"))


def live_verdict(passages: DataFrame, claim: str, order: str | None = None) -> DataFrame:
    """(claim, verdict) of live_scored()."""
    return live_scored(passages, claim, order).drop("confidence")


def rounded(value: Column, places: int) -> Column:
    """value as SQL rounds doubles: its product with 10^places is rounded, not its decimal form."""
    return F.round(value * 10.0**places) / 10.0**places


def softmax(logits: Column, temperature: float) -> Column:
    """Probabilities of an array of logits."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp((x - top) / temperature))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def band(confidence: Column) -> Column:
    return F.when(confidence >= 0.6, "high").when(confidence >= 0.4, "medium").otherwise("low")
