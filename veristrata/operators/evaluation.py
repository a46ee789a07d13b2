"""Edit rates, chrF, spans, gates and resampled intervals over evaluation rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veristrata.operators.metrics import numbered, ratio, wilson


def word_edits(a: Column, b: Column) -> Column:
    """Fewest words of array a to put in, take out or replace to get array b (N-52): one table row held at a time.

    Within a row, cell j is the least over k <= j of (cell k without putting in) + j - k, so a running minimum replaces
    the dependence of a cell on the one before it.
    """

    def row(last, x):
        # without words put in: take x out, or replace it
        cell = F.transform(b, lambda y, j: F.least(F.get(last, j + 1) + 1, F.get(last, j) + F.when(x == y, 0).otherwise(1)) - j - 1)
        start = F.array(F.get(last, F.lit(0)) + 1)
        low = F.aggregate(cell, start, lambda out, c: F.concat(out, F.array(F.least(F.element_at(out, -1), c))))
        return F.transform(low, lambda c, j: c + j)

    first = F.sequence(F.lit(0), F.size(b))
    return F.element_at(F.aggregate(a, first, row), -1)


def chrf(rows: DataFrame, key: str, longest: int = 6, beta: float = 2.0) -> DataFrame:
    """(key, chrf) of rows(key, hyp, ref) (N-53): n-grams without white space, common ones by the smaller count, orders that a side lacks left out of its mean."""
    bare = rows.select(key, *(F.regexp_replace(c, r"(?U)\s+", "").alias(c) for c in ("hyp", "ref")))
    sizes = F.explode(F.array(*map(F.lit, range(1, longest + 1)))).alias("n")
    each = bare.select(key, "hyp", "ref", sizes)

    def grams(side):
        text = each.filter(F.length(side) >= F.col("n")).select(key, "n", F.col(side).alias("t"), F.explode(F.sequence(F.lit(1), F.length(side) - F.col("n") + 1)).alias("i"))
        return text.select(key, "n", F.expr("substr(t, i, n)").alias("g"), F.lit(side).alias("side"))

    counts = grams("hyp").unionByName(grams("ref")).groupBy(key, "n", "g").agg(F.count(F.when(F.col("side") == "hyp", 1)).alias("h"), F.count(F.when(F.col("side") == "ref", 1)).alias("r"))
    orders = counts.groupBy(key, "n").agg(F.sum(F.least("h", "r")).alias("both"), F.sum("h").alias("h"), F.sum("r").alias("r"))
    # avg leaves out the orders that a side lacks
    means = orders.groupBy(key).agg(F.avg(F.try_divide("both", "h")).alias("p"), F.avg(F.try_divide("both", "r")).alias("q"))
    p, q = F.coalesce("p", F.lit(0.0)), F.coalesce("q", F.lit(0.0))
    score = F.when(F.isnull("p") | F.isnull("q"), 0.0).otherwise(ratio((1 + beta**2) * p * q, beta**2 * p + q))
    return rows.select(key).join(means, key, "left").select(key, F.coalesce(score, F.lit(0.0)).alias("chrf"))


def span_scores(tags: DataFrame, post: str) -> DataFrame:
    """Token precision, recall and F1 and exact matches over tags(post, gold, pred), booleans of aligned tokens (M-22)."""
    g, p = F.col("gold").cast("int"), F.col("pred").cast("int")
    posts = tags.groupBy(post).agg(F.sum(g * p).alias("tp"), F.sum(p).alias("p"), F.sum(g).alias("g"), F.min((g == p).cast("int")).alias("exact"))
    s = posts.agg(F.sum("tp").alias("tp"), F.sum("p").alias("p"), F.sum("g").alias("g"), F.avg("exact").alias("exact_span_match"), F.count("*").alias("n"))
    s = s.withColumns({"token_precision": ratio(F.col("tp"), F.col("p")), "token_recall": ratio(F.col("tp"), F.col("g"))})
    return s.withColumn("token_f1", ratio(2 * F.col("token_precision") * F.col("token_recall"), F.col("token_precision") + F.col("token_recall"))).drop("tp", "p", "g")


def fast_path_curve(rows: DataFrame, taus: list[float]) -> DataFrame:
    """Per tau: coverage, precision, yield and false accepts of rows(top, correct, wrong) (M-19).

    correct is null where nothing is right at all: such rows count among the false accepts only. wrong, the best score
    of a wrong candidate, is null where there is none.
    """
    grid = rows.select("*", F.explode(F.array(*map(F.lit, taus))).alias("tau"))
    judged, taken = F.col("correct").isNotNull(), F.col("top") >= F.col("tau")
    n = lambda c: F.count(F.when(c, 1))
    s = grid.groupBy("tau").agg(n(judged).alias("n"), n(judged & taken).alias("accepted"), n(taken & F.col("correct")).alias("right"), F.count("wrong").alias("negatives"), n(F.col("wrong") >= F.col("tau")).alias("false_accepts"), n(~judged).alias("natural"))
    c = F.col
    return s.select("tau", "n", "accepted", "negatives", "natural", ratio(c("accepted"), c("n")).alias("coverage"), ratio(c("right"), c("accepted")).alias("precision"), ratio(c("right"), c("n")).alias("yield"), ratio(c("false_accepts"), c("negatives")).alias("false_accept_rate"))


def real_claims(rows: DataFrame) -> DataFrame:
    """Of all rows(gold, shown, decider) and of each decider: what is shown, right, and wrongly supported, with Wilson limits (M-28)."""
    shown = F.col("shown").isNotNull()
    right = (F.col("shown") == "Supported") == (F.col("gold") == "T")
    decidable = shown & F.col("gold").isin("T", "F")
    n = lambda c: F.count(F.when(c, 1))
    s = rows.groupingSets([[], ["decider"]], "decider").agg(
        F.grouping("decider").alias("every"), F.count("*").alias("n"), n(shown).alias("shown"), n(decidable).alias("decidable"), n(decidable & right).alias("correct"),
        n(F.col("gold") == "F").alias("gold_false"), n((F.col("gold") == "F") & (F.col("shown") == "Supported")).alias("false_supported"), n(shown & (F.col("gold") == "U")).alias("on_unverifiable"),
    )
    p_lo, _ = wilson(F.col("correct"), F.col("decidable"))
    _, f_hi = wilson(F.col("false_supported"), F.col("gold_false"))
    s = s.withColumns({"precision": F.try_divide("correct", "decidable"), "precision_lo": F.when(F.col("decidable") > 0, p_lo).otherwise(0.0), "false_supported_hi": F.when(F.col("gold_false") > 0, f_hi).otherwise(1.0)})
    ok_p = F.coalesce((F.col("precision") >= 0.85) & (F.col("precision_lo") >= 0.80), F.lit(False))
    ok_f = F.col("false_supported_hi") <= 0.08
    verdict = F.when(ok_p & ok_f, "transfers").when(ok_p | ok_f, "partly transfers").otherwise("does not transfer")
    return s.withColumn("transfers", verdict).withColumn("decider", F.when(F.col("every") == 1, "all").otherwise(F.coalesce("decider", F.lit("none")))).drop("every")


def draws(unit: Column, resample: Column) -> Column:
    """How often a resample draws a unit: Poisson with mean 1, from a hash that SQL shares. Rows need no index and no join."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", resample.cast("string"), unit.cast("string"))), 1, 12), 16, 10).cast("bigint") / float(2**48)
    limits, total = [], 0.0
    for k in range(8):
        total += math.exp(-1) / math.factorial(k)
        limits.append(total)
    out = F.lit(8)
    for k in reversed(range(8)):
        out = F.when(u < limits[k], k).otherwise(out)
    return out


def bootstrap(rows: DataFrame, unit: str, value: Column, resamples: int = 200) -> DataFrame:
    """Mean of value over rows, and its 2.5th and 97.5th percentile (nearest rank) over resamples of whole units (M-25, M-30).

    unit: a row's id, or its cluster, all of whose rows are drawn together.
    """
    each = rows.select(F.col(unit).alias("unit"), value.cast("double").alias("v")).groupBy("unit").agg(F.sum("v").alias("v"), F.count("v").alias("n"))
    b = each.select("*", F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("b"))
    w = b.withColumn("w", draws(F.col("unit"), F.col("b")))
    means = w.groupBy("b").agg((F.sum(F.col("w") * F.col("v")) / F.sum(F.col("w") * F.col("n"))).alias("m"))
    ends = means.agg(F.expr("percentile_disc(0.025) WITHIN GROUP (ORDER BY m)").alias("lo"), F.expr("percentile_disc(0.975) WITHIN GROUP (ORDER BY m)").alias("hi"))
    return each.agg((F.sum("v") / F.sum("n")).alias("mean")).crossJoin(ends)


def stance_features(passages: DataFrame, claim: str, k: int = 10) -> DataFrame:
    """A-10: 19 features of each claim's k best passages(claim, rank from 1, support, refute, neutral, dense)."""
    s, r, u, w = F.col("support"), F.col("refute"), F.col("neutral"), 1 / F.log2(F.col("rank") + 1)
    first = lambda c: F.max(F.when(F.col("rank") == 1, c))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    best = passages.filter(F.col("rank") <= k)
    return best.groupBy(claim).agg(
        F.avg(s).alias("mean_s"), F.avg(r).alias("mean_r"), F.avg(u).alias("mean_n"), F.max(s).alias("max_s"), F.max(r).alias("max_r"), F.max(u).alias("max_n"),
        F.min(s).alias("min_s"), F.min(r).alias("min_r"), F.avg((s >= 0.5).cast("int")).alias("share_s"), F.avg((r >= 0.5).cast("int")).alias("share_r"),
        (F.sum(w * (s - r)) / F.sum(w)).alias("ranked"), first(s).alias("top_s"), first(r).alias("top_r"), first(u).alias("top_n"), (F.max(s) * F.max(r)).alias("product"),
        zero(F.max("dense")).alias("dense_max"), zero(F.avg("dense")).alias("dense_mean"), (F.count("dense") > 0).cast("double").alias("has_dense"), (F.count("*") / k).alias("filled"),
    )


def select_tau(rows: DataFrame, precision: float = 0.9, false_supported: int = 0, baseline: int = 0) -> DataFrame:
    """V-12: the least confidence of rows(gold, pred, confidence) at which what is shown is right by `precision`, wrongly
    supported (pred 1, gold 0) at most so often, and right 1.3 times as often as the baseline; null where there is none.

    Counts at each confidence, summed from the highest down by ranges: no task orders all rows.
    """
    right, bad = (F.col("gold") == F.col("pred")).cast("bigint"), ((F.col("pred") == 1) & (F.col("gold") == 0)).cast("bigint")
    c = rows.groupBy("confidence").agg(F.count("*").alias("n"), F.sum(right).alias("r"), F.sum(bad).alias("b"))
    down = c
    for name in ("n", "r", "b"):
        summed = numbered(c.select("confidence", name), [], [F.desc("confidence")], name).select("confidence", F.col("total").alias(f"{name}_at"))
        down = down.join(summed, "confidence")
    least = math.ceil(1.3 * baseline)
    good = down.filter((F.col("r_at") >= precision * F.col("n_at")) & (F.col("r_at") >= least) & (F.col("b_at") <= false_supported))
    return good.agg(F.min("confidence").alias("tau"))


def cross_cosines(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """M-37: (a, b, cosine) of every two groups: the mean over all pairs of rows, which is the product of the mean unit vectors."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = rows.select(F.col(group).alias("g"), F.posexplode(vector).alias("i", "x"), norm.alias("norm"))
    mean = unit.groupBy("g", "i").agg(F.avg(F.col("x").cast("double") / F.col("norm")).alias("m"))
    other = mean.select(F.col("g").alias("b"), "i", F.col("m").alias("k"))
    pairs = mean.withColumnRenamed("g", "a").join(other, "i").filter("a < b")
    return pairs.groupBy("a", "b").agg(F.sum(F.col("m") * F.col("k")).alias("cosine"))


def word_faithfulness(rows: DataFrame) -> DataFrame:
    """M-26: rows(top, rnd, bottom), the falls in probability without the top, random and bottom words: the top ones win over
    random ones in 0.8 of rows, fall twice as far, and bottom ones no farther than random ones."""
    top, rnd, bottom = F.avg("top"), F.avg("rnd"), F.avg("bottom")
    win = F.avg((F.col("top") > F.col("rnd")).cast("int"))
    passes = (win >= 0.8) & (F.try_divide(top, rnd) >= 2) & (bottom <= rnd)
    return rows.agg(F.count("*").alias("n"), F.round(win, 6).alias("win_rate"), F.round(F.try_divide(top, rnd), 4).alias("ratio"), (bottom <= rnd).alias("bottom_ok"), F.coalesce(passes, F.lit(False)).alias("passes"))
