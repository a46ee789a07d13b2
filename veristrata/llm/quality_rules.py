"""Quality rules: base counts of a text, and cross-document line frequency.

Lines are normalised (white space collapsed, lower case) and hashed. Per host, each distinct line counts the distinct
documents that hold it; documents with the same lines count once, so plain copies do not make their lines frequent.
A line is over the limits in more than max_docs documents of its host or, on small hosts, in more than max_share of
them and more than min_docs. Such lines are removed from all but one holder (that with the smallest number of its
lines, with its copies), so that a repeated block keeps one home and near copies of a document keep one of them. A
document left with less than min_left of its characters is depleted and rejected.

Everything is DataFrame functions. Documents of one host and fingerprint are merged before lines are exploded;
counting combines before its shuffle, so neither a hot host nor a hot line gathers in one task.

Null and empty texts have no words: their counts are 0 and base_failed is true. Null hosts are one host. Repeated
rows give one row each. Word windows are compared by 64-bit hashes. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.llm import shared

#: Limits of the base rules (fixed by the contract).
MIN_WORDS, MAX_REPEATED = 50, 50
#: Limits of a line's frequency on a host, and the share of a document's characters that must stay.
MAX_DOCS, MAX_SHARE, MIN_LEFT = 100, 0.25, 0.3
#: So few documents never make a line frequent, however small their host is.
MIN_DOCS = 10


def words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(shared.SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, shared.SPACES))


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the array _lines."""
    # each step keeps what the lambdas of the next read, so that it is computed once a row
    lines = F.filter(F.split(F.col("_t"), "\n", -1), lambda x: F.btrim(x, F.lit(shared.SPACE_CHARS)) != "")
    df = docs.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumns({"_w": words(F.col("_t")), "_lines": lines})
    window = F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))
    df = df.withColumns({
        "n_words": F.size("_w").cast("bigint"),
        "word_chars": F.length(F.array_join("_w", "")).cast("bigint"),
        "n_symbols": (F.size(F.split("_t", r"[#*$%&|<>]", -1)) - 1).cast("bigint"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        "_h": F.when(F.size("_w") >= 3, window).otherwise(F.array().cast("array<bigint>")),
    })
    # windows in the order of their hashes; those beside an equal one repeat
    ordered = F.when(F.size("_h") > F.size(F.array_distinct("_h")), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.withColumn("_s", ordered)
    repeats = F.filter("_s", lambda x, i: F.coalesce(F.get("_s", i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("_s", i + 1)["h"] == x["h"], F.lit(False)))
    df = df.withColumn("_p", F.sort_array(F.transform(repeats, lambda x: x["i"])))
    covered = F.aggregate(F.transform("_p", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_p", k + 1), p + 3) - p)), F.lit(0), lambda a, x: a + x)
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return df.withColumn("base_failed", failed).drop("_t", "_w", "_h", "_s", "_p")


def with_lines(df: DataFrame) -> DataFrame:
    """df with _marks, the (hash, characters) of the distinct normalised lines of _lines, and _fp, a number of them all."""
    clean = F.transform("_lines", lambda x: F.lower(F.regexp_replace(F.btrim(x, F.lit(shared.SPACE_CHARS)), shared.SPACES, " ")))
    df = df.withColumn("_lines", F.array_sort(F.array_distinct(clean)))
    fp = F.conv(F.substring(F.md5(F.array_join("_lines", "\n")), 1, 15), 16, 10).cast("bigint")
    return df.withColumns({"_marks": F.transform("_lines", lambda x: F.struct(F.xxhash64(x).alias("h"), F.length(x).alias("n"))), "_fp": fp})


def host_key(host: str) -> Column:
    """A host as a string that is never null."""
    return F.when(F.col(host).isNull(), "").otherwise(F.concat(F.lit("="), F.col(host).cast("string")))


def depleted(marked: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT, min_docs: int = MIN_DOCS) -> DataFrame:
    """(host, fp) of the depleted documents of marked(host, fp, marks)."""
    unique = marked.groupBy("host", "fp").agg(F.first("marks").alias("marks"))
    total = unique.groupBy("host").agg(F.count("*").alias("docs"))
    lines = unique.select("host", "fp", F.explode("marks").alias("m")).select("host", "fp", "m.h", "m.n")
    counted = lines.groupBy("host", "h").agg(F.count("*").alias("holders"), F.min("fp").alias("home"))
    over = (F.col("holders") > max_docs) | (F.col("holders") > min_docs) & (F.col("holders") > max_share * F.col("docs"))
    frequent = counted.filter(F.col("holders") > min(min_docs, max_docs)).join(total, "host").filter(over)
    removed = lines.join(frequent.select("host", "h", "home"), ["host", "h"]).filter(F.col("fp") != F.col("home"))
    removed = removed.groupBy("host", "fp").agg(F.sum("n").alias("removed"))
    size = F.aggregate("marks", F.lit(0).cast("bigint"), lambda a, m: a + m["n"])
    return removed.join(unique.select("host", "fp", size.alias("size")), ["host", "fp"]).filter(F.col("size") - F.col("removed") < min_left * F.col("size")).select("host", "fp")


def judge(docs: DataFrame, host: str = "source", text: str = "text", **limits) -> DataFrame:
    """docs' columns but the text (those named like a result give way to it), with the base counts, base_failed and kept. Texts are read once; what stays of them is written."""
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    own = [c for c in docs.columns if c != text and c not in made]
    row = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(own))).alias(shared.ROW)
    held = docs.select(row, host_key(host).alias("_host"), F.col(f"`{text}`").alias("_text"))
    based = shared.materialise(with_lines(with_base(held, "_text")).drop("_text", "_lines"), "quality")
    gone = shared.materialise(depleted(based.select(F.col("_host").alias("host"), F.col("_fp").alias("fp"), F.col("_marks").alias("marks")), **limits), "depleted")
    gone = gone.select(F.col("host").alias("_host"), F.col("fp").alias("_fp"), F.lit(True).alias("_gone"))
    judged = based.join(gone, ["_host", "_fp"], "left").withColumn("kept", ~F.col("base_failed") & F.col("_gone").isNull())
    return judged.select(*(F.col(shared.ROW)[f"c{n}"].alias(c) for n, c in enumerate(own)), *made)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(shared.table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("source")


def keep_good(docs: DataFrame, host: str = "source", text: str = "text", **limits) -> DataFrame:
    """The rows of docs that the rules keep, all columns as they are.

    Base rules act on the scan itself; the depleted documents, whose written table has a known size, are then taken
    away by an anti-join, which the planner broadcasts only if that size allows.
    """
    held = shared.as_row(docs, _host=host_key(host), _text=F.col(text))
    based = with_lines(with_base(held, "_text"))
    gone = shared.materialise(depleted(based.select(F.col("_host").alias("host"), F.col("_fp").alias("fp"), F.col("_marks").alias("marks")), **limits), "depleted")
    gone = gone.select(F.col("host").alias("_host"), F.col("fp").alias("_fp"))
    # the row's number keeps the filter and the join above the counts, whose arrays would else be made again for each element
    based = based.withColumn("_at", F.monotonically_increasing_id())
    return shared.from_row(based.filter(~F.col("base_failed") & (F.col("_at") >= 0)).join(gone, ["_host", "_fp"], "left_anti"), docs)
