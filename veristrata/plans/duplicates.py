"""Queries of duplicate groups, splits, overlaps and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from veristrata.operators.metrics import numbered
from veristrata.registry import query, table


def hashed(column: str):
    """The first 60 bits of a key's md5 as a number."""
    return F.conv(F.substring(F.md5(F.col(column).cast("string")), 1, 15), 16, 10).cast("bigint")


HASH = "('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT"


@query("exact_dup_groups", "SELECT sha1(text) AS text_sha1, count(*) AS n, min(doc_id) AS kept FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dup_groups(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha1("text").alias("text_sha1")).agg(F.count("*").alias("n"), F.min("doc_id").alias("kept")).filter("n > 1")


@query("cross_split_overlap", f"WITH s AS (SELECT doc_id, sha1(text) AS h, {HASH} % 3 AS split FROM documents) SELECT a.split AS split_a, b.split AS split_b, a.h AS text_sha1, min(a.doc_id) AS uid_a, b.doc_id AS uid_b FROM s a JOIN s b ON a.h = b.h AND a.split < b.split GROUP BY ALL")
def cross_split_overlap(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("doc_id", F.sha1("text").alias("h"), (hashed("doc_id") % 3).alias("split"))
    a = s.groupBy("h", F.col("split").alias("split_a")).agg(F.min("doc_id").alias("uid_a"))
    b = s.select("h", F.col("split").alias("split_b"), F.col("doc_id").alias("uid_b"))
    return a.join(b, "h").filter("split_a < split_b").select("split_a", "split_b", F.col("h").alias("text_sha1"), "uid_a", "uid_b")


@query("dedup_train_yields", f"WITH s AS (SELECT doc_id, sha1(text) AS h, {HASH} % 10 < 8 AS train FROM documents), t AS (SELECT * FROM s WHERE train AND h NOT IN (SELECT h FROM s WHERE NOT train)) SELECT min(doc_id) AS doc_id, h AS text_sha1 FROM t GROUP BY h")
def dedup_train_yields(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("doc_id", F.sha1("text").alias("h"), (hashed("doc_id") % 10 < 8).alias("train"))
    return s.filter("train").join(s.filter(~F.col("train")).select("h"), "h", "left_anti").groupBy("h").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.col("h").alias("text_sha1"))


@query("stratified_holdout", f"WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {HASH}, doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT doc_id, source FROM r WHERE r <= CASE WHEN n > 1 THEN greatest(1, round_even(n * 0.1, 0)) ELSE 0 END")
def stratified_holdout(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    r = numbered(d.withColumn("h", hashed("doc_id")), ["source"], ["h", "doc_id"]).withColumnRenamed("number", "r").join(d.groupBy("source").agg(F.count("*").alias("n")), "source")
    return r.filter(F.col("r") <= F.when(F.col("n") > 1, F.greatest(F.lit(1), F.bround(F.col("n") * 0.1))).otherwise(0)).select("doc_id", "source")


@query("split_80_10_10", f"WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {HASH}, doc_id) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT lang, CASE WHEN r < floor(n * 0.8) THEN 'train' WHEN r < floor(n * 0.8) + floor(n * 0.1) THEN 'dev' ELSE 'test' END AS split, count(*) AS n FROM r GROUP BY 1, 2")
def split_80_10_10(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    r = numbered(d.withColumn("h", hashed("doc_id")), ["lang"], ["h", "doc_id"]).withColumn("r", F.col("number") - 1).join(d.groupBy("lang").agg(F.count("*").alias("total")), "lang")
    a, b = F.floor(F.col("total") * 0.8), F.floor(F.col("total") * 0.1)
    return r.groupBy("lang", F.when(F.col("r") < a, "train").when(F.col("r") < a + b, "dev").otherwise("test").alias("split")).agg(F.count("*").alias("n"))


@query("round_robin_deal", f"SELECT doc_id, row_number() OVER (PARTITION BY quality ORDER BY {HASH}, doc_id) AS turn, quality FROM labels")
def round_robin_deal(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality", hashed("doc_id").alias("h"))
    return numbered(rows, ["quality"], ["h", "doc_id"]).select("doc_id", F.col("number").alias("turn"), "quality")


@query("coverage_missing_unknown", "SELECT 'missing' AS kind, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'unknown', doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def coverage_missing_unknown(spark, sf_dir):
    d, x = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    return d.join(x, "doc_id", "left_anti").select(F.lit("missing").alias("kind"), "doc_id").unionByName(x.join(d, "doc_id", "left_anti").select(F.lit("unknown").alias("kind"), "doc_id"))


@query("dev_test_intersect", f"SELECT sha1(text) AS h FROM documents WHERE {HASH} % 10 = 8 INTERSECT SELECT sha1(text) FROM documents WHERE {HASH} % 10 = 9")
def dev_test_intersect(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.sha1("text").alias("h"), (hashed("doc_id") % 10).alias("s"))
    return d.filter("s = 8").select("h").intersect(d.filter("s = 9").select("h"))


@query("corpus_union", "SELECT kind, count(*) AS n, sum(length(text)) AS chars FROM (SELECT 'document' AS kind, text FROM documents UNION ALL SELECT 'item', text FROM benchmark UNION ALL SELECT role, text FROM conversations) GROUP BY kind")
def corpus_union(spark, sf_dir):
    parts = [table(spark, sf_dir, t).select(k.alias("kind"), "text") for t, k in (("documents", F.lit("document")), ("benchmark", F.lit("item")), ("conversations", F.col("role")))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("order_revenue", "SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def order_revenue(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return o.groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("revenue"))
