"""Samples, splits by parent, accepted pairs and the guards of splits (L-10 to L-12, L-14, L-15, J-05, J-13, J-15, W-06, T-06, F-07).

Orders within a label are by hash, so a sample does not depend on how rows are partitioned; ranks come from
`metrics.numbered`, so no task orders a whole label.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veristrata.operators.metrics import numbered

#: The variable that allows a job to look at a test split.
ALLOW = "VERISTRATA_ALLOW_TEST"


def shuffled(key: Column, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def first_seen(rows: DataFrame, by: Column, order: str) -> DataFrame:
    """W-06, O-04: of rows with equal `by` the one that is first in `order` (a unique column). Null `by` are one group."""
    first = rows.groupBy(by.alias("__by")).agg(F.min(order).alias(order)).select(order)
    return rows.join(first, order, "left_semi")


def dealt(rows: DataFrame, key: str, label: str, sizes: dict[str, int], seed: int = 42) -> DataFrame:
    """L-10: rows with `sample` and `pos`: each label's rows in hash order, the first n to the first sample, the next to the
    second, and so on, so that samples are disjoint; pos deals round-robin over the labels in order. Others are left out."""
    order = numbered(rows.withColumn("__h", shuffled(F.col(key), seed)), [label], [F.col("__h"), F.col(key)])
    at, sample, own = 0, F.lit(None).cast("string"), F.lit(None).cast("bigint")
    for name, n in sizes.items():
        here = (F.col("number") > at) & (F.col("number") <= at + n)
        sample, own = F.when(here, name).otherwise(sample), F.when(here, F.col("number") - at).otherwise(own)
        at += n
    picked = order.withColumns({"sample": sample, "__own": own}).filter("sample IS NOT NULL").drop("number", "__h")
    # as many rows as the samples hold
    return numbered(picked, ["sample"], [F.col("__own"), F.col(label)]).withColumnRenamed("number", "pos").drop("__own")


def relabelled(rows: DataFrame, truth: DataFrame, key: str, label: str, when: Column, names: dict[str, str]) -> DataFrame:
    """L-11: where `when` holds, the label is that of truth(key, truth) under its name; a row without one is an error."""
    j = rows.join(truth.select(key, "truth"), key, "left")
    named = F.try_element_at(F.create_map(*(F.lit(x) for p in names.items() for x in p)), F.col("truth"))
    found = F.when(named.isNull(), F.raise_error(F.concat(F.lit("no truth for "), F.col(key).cast("string")))).otherwise(named)
    return j.withColumn(label, F.when(when, found).otherwise(F.col(label))).drop("truth")


def capped(rows: DataFrame, key: str, label: str, made: str, most: int, seed: int = 42) -> DataFrame:
    """L-12: at most `most` rows of a label, real ones (made is false) first, made ones fill up."""
    return numbered(rows.withColumn("__h", shuffled(F.col(key), seed)), [label], [F.col(made), F.col("__h"), F.col(key)]).filter(F.col("number") <= most).drop("number", "__h")


def error_sample(rows: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """L-15: n wrong rows(id, gold, pred): round-robin over the (gold, pred) pairs, larger ones first, in hash order in each."""
    wrong = rows.filter("gold <> pred")
    sizes = wrong.groupBy("gold", "pred").agg(F.count("*").alias("__size"))  # one row for each pair of labels
    own = numbered(wrong.withColumn("__h", shuffled(F.col("id"), seed)), ["gold", "pred"], [F.col("__h"), F.col("id")]).filter(F.col("number") <= n)
    order = [F.col("number"), F.desc("__size"), F.concat_ws(",", "gold", "pred")]
    return own.join(F.broadcast(sizes), ["gold", "pred"]).orderBy(*order).limit(n).drop("number", "__h", "__size")


def inherited(children: DataFrame, parents: DataFrame, parent: Column, split: str = "split") -> DataFrame:
    """J-13: children with the split of their parent(source_id, split); one without a parent is dropped."""
    return children.withColumn("__p", parent).join(parents.select(F.col("source_id").alias("__p"), F.col(split)), "__p").drop("__p")


def parent_id(source_id: Column) -> Column:
    """set_stance:train.json:2557:q0:a1 belongs to set:train.json:2557."""
    return F.regexp_replace(source_id, r"^([a-z0-9_]+)_stance:([^:]+):(\d+).*$", "$1:$2:$3")


def pool_of(source_id: Column) -> Column:
    """J-05: (store, claim_idx) of ids like set:dev.json:12."""
    return F.struct(F.regexp_extract(source_id, r":(train|dev|test)\.json:", 1).alias("store"), F.regexp_extract(source_id, r":(\d+)$", 1).cast("bigint").alias("claim_idx"))


def with_pools(rows: DataFrame, pools: DataFrame) -> DataFrame:
    """rows(source_id) with their pool's passages(store, claim_idx, ...). A run reads one store; more are an error."""
    keyed = rows.select("*", pool_of(F.col("source_id")).alias("__k")).select("*", "__k.store", "__k.claim_idx").drop("__k")
    stores = [r[0] for r in keyed.select("store").distinct().limit(2).collect()]
    if len(stores) > 1:
        raise ValueError(f"rows of more than one store: {sorted(stores)}")
    return keyed.join(pools, ["store", "claim_idx"], "left")


def not_accepted(pairs: DataFrame, accepted: DataFrame) -> DataFrame:
    """J-15: pairs(dataset, a, b) that are not in the accepted list, whichever of the two comes first."""
    ends = lambda d: d.withColumns({"__lo": F.least("a", "b"), "__hi": F.greatest("a", "b")})
    return ends(pairs).join(ends(accepted).select("dataset", "__lo", "__hi"), ["dataset", "__lo", "__hi"], "left_anti").drop("__lo", "__hi")


def inclusive_ends(spans: DataFrame) -> DataFrame:
    """L-14: how many of spans(start, stop, tokens, text_tokens) fit a text if the end belongs to the span, and if it doesn't."""
    length = F.col("stop") - F.col("start")
    fits = lambda c: F.count(F.when(c, 1))
    return spans.agg(F.count("*").alias("n"), fits(length + 1 == F.col("tokens")).alias("inclusive"), fits(length == F.col("tokens")).alias("exclusive"), fits((F.col("stop") < F.col("text_tokens")) & (F.col("start") >= 0)).alias("inside"))


def shard(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """T-06: rows offset + 1 to offset + limit in order; the order is total if its last column is unique."""
    return numbered(rows, [], order).filter(F.col("number").between(offset + 1, offset + limit)).drop("number")


def require_allowed(rows: DataFrame, path: str | None = None) -> DataFrame:
    """F-07: rows as they are, unless they are of a test split and ALLOW isn't 1: a file test.*, or a row whose split or uid says so."""
    test = path is not None and os.path.basename(path.rstrip("/")).split(".")[0] == "test"
    if not test:
        marks = [F.col("split") == "test"] if "split" in rows.columns else []
        marks += [F.get(F.split("uid", ":"), F.lit(2)) == "test"] if "uid" in rows.columns else []
        says = F.lit(False)
        for m in marks:
            says = says | F.coalesce(m, F.lit(False))
        test = not rows.filter(says).isEmpty()
    if test and os.environ.get(ALLOW) != "1":
        raise PermissionError(f"a test split is read once, for the final figures: set {ALLOW}=1 to allow it")
    return rows
