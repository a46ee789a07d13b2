"""Evaluation metrics over rows of (gold, pred, confidence, ...). Empty denominators give 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def confusion(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """n of every (gold, pred) of labels(label), zero cells included. labels is the declared set: a handful of rows."""
    g, p = labels.select(F.col("label").alias("gold")), labels.select(F.col("label").alias("pred"))
    return g.crossJoin(p).join(rows.groupBy("gold", "pred").agg(F.count("*").alias("n")), ["gold", "pred"], "left").fillna(0, ["n"])


def per_class(rows: DataFrame, labels: DataFrame, by: list[str] = []) -> DataFrame:
    """precision, recall, f1 and support of each declared label, in each group of by."""
    cells = rows.groupBy(*by, "gold", "pred").agg(F.count("*").alias("n"))
    groups = rows.select(*by).distinct() if by else None
    both = labels if groups is None else groups.crossJoin(F.broadcast(labels))
    hit = (F.col("gold") == F.col("label")) & (F.col("pred") == F.col("label"))
    on = [both[c] == cells[c] for c in by] + [(F.col("gold") == F.col("label")) | (F.col("pred") == F.col("label"))]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    s = both.join(cells, cond, "left").groupBy(*[both[c] for c in by], "label")
    s = s.agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("pred") == F.col("label"), F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("gold") == F.col("label"), F.col("n")).otherwise(0)).alias("support"))
    s = s.withColumns({"precision": ratio(F.col("tp"), F.col("p")), "recall": ratio(F.col("tp"), F.col("support"))})
    return s.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).drop("tp", "p")


def macro_f1(rows: DataFrame, labels: DataFrame, by: list[str] = []) -> DataFrame:
    return per_class(rows, labels, by).groupBy(*by).agg(F.avg("f1").alias("macro_f1"))


def wilson(hits: Column, n: Column, z: float = 1.959964) -> tuple[Column, Column]:
    p = hits / n
    mid, span = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.greatest(F.lit(0.0), (mid - span) / (1 + z * z / n)), F.least(F.lit(1.0), (mid + span) / (1 + z * z / n))


def reliability(rows: DataFrame, bins: int = 10) -> DataFrame:
    """bin, n, accuracy and mean confidence of equal-width bins."""
    b = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).alias("bin")
    return rows.groupBy(b).agg(F.count("*").alias("n"), F.avg((F.col("gold") == F.col("pred")).cast("int")).alias("accuracy"), F.avg("confidence").alias("mean_confidence"))


def ece(rows: DataFrame, bins: int = 10) -> DataFrame:
    return reliability(rows, bins).agg((F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("mean_confidence"))) / F.sum("n")).alias("ece"))


#: Ranges into which an order is cut for counting.
RANGES = 256


def numbered(rows: DataFrame, by: list[str], order: list, running: str | None = None, ranges: int = RANGES) -> DataFrame:
    """rows with `number`, from 1, in their order within the groups `by`; running: a column summed up to each row as `total`.

    However large a group is, no task orders more than one of `ranges` ranges of the whole: ranges are cut by sampled
    quantiles, counted by group, and the counts before a range are added to the numbers within it.
    """
    cut = rows.repartitionByRange(ranges, *by, *order).withColumn("__range", F.spark_partition_id())
    here, before = Window.partitionBy("__range", *by), Window.partitionBy(*by).orderBy("__range")
    sums = [F.count("*").alias("__n"), *([F.sum(running).alias("__s")] if running else [])]
    counts = cut.groupBy("__range", *by).agg(*sums)
    # at most `ranges` rows of each group
    ahead = lambda c: (F.sum(c).over(before) - F.col(c)).alias(f"{c}_ahead")
    counts = counts.select("__range", *by, ahead("__n"), *([ahead("__s")] if running else []))
    own = cut.withColumn("__own", F.row_number().over(here.orderBy(*order)))
    if running:
        own = own.withColumn("__sum", F.sum(running).over(here.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    own = own.join(F.broadcast(counts) if not by else counts, ["__range", *by]).withColumn("number", F.col("__own") + F.col("__n_ahead"))
    if running:
        own = own.withColumn("total", F.col("__sum") + F.col("__s_ahead"))
    return own.drop("__range", "__own", "__n_ahead", "__sum", "__s_ahead")


def coverage_curve(rows: DataFrame, points: int = 20) -> DataFrame:
    """(point, coverage, accuracy) at points + 1 shares of the rows, by confidence; ties in order of id."""
    rows = rows.select("id", "confidence", (F.col("gold") == F.col("pred")).cast("int").alias("right"))
    ranked = numbered(rows, [], [F.desc("confidence"), F.col("id")], "right").select(F.col("number").alias("at"), F.col("total").alias("right"))
    total = rows.agg(F.count("*").alias("n"))
    grid = rows.sparkSession.range(points + 1).select(F.col("id").alias("point")).crossJoin(total)
    grid = grid.withColumn("at", F.greatest(F.lit(1), F.ceil(F.col("point") / points * F.col("n"))).cast("bigint"))
    return ranked.join(F.broadcast(grid), "at").select("point", (F.col("at") / F.col("n")).alias("coverage"), (F.col("right") / F.col("at")).alias("accuracy"))


def lowering_edits(text: str) -> Column:
    """Edit distance between a whole text and its lower case, in linear time for all but rare texts.

    `gone` are the characters of the text that its lower case does not hold: each costs an edit. If the lower case is
    as long and leaves all others alone, replacing just those gives it, so their number is the distance. Any other
    text (one with a letter that lowers to two) takes the full table, whose memory grows with the length only.
    """
    t, low = F.col(text), F.lower(text)
    gone = F.call_function("translate", t, low, F.lit(""))
    rest = F.call_function("translate", t, gone, F.lit(""))
    return F.when((F.length(low) == F.length(t)) & (F.lower(rest) == rest), F.length(gone)).otherwise(F.levenshtein(t, low))


def retrieval_by_query(ranked: DataFrame, gold: DataFrame, query: str, key: str, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """rr, recall and success at ks of each query with gold; queries without hits count 0."""
    n = gold.groupBy(query).agg(F.count("*").alias("relevant"))
    return retrieval_by_counts(ranked.join(gold, [query, key], "left_semi"), n, query, ks)


def retrieval_by_counts(found: DataFrame, relevant: DataFrame, query: str, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """retrieval_by_query() of found(query, rank), relevant rows only, and relevant(query, relevant), their number."""
    hits = found.groupBy(query).agg(F.min("rank").alias("first"), *(F.sum((F.col("rank") <= k).cast("int")).alias(f"h{k}") for k in ks))
    j = relevant.join(hits, query, "left")
    return j.select(query, F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"), *(F.coalesce(F.col(f"h{k}") / F.col("relevant"), F.lit(0.0)).alias(f"recall_{k}") for k in ks), *(F.coalesce((F.col("first") <= k).cast("int"), F.lit(0)).alias(f"success_{k}") for k in ks))
