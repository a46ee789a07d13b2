"""Further queries: fingerprints, agreement, grids and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veristrata.functions.text import char_shingles, tokens
from veristrata.plans.metrics import PRED, predictions
from veristrata.registry import query, table
from veristrata.streaming import windows


@query("nll_temperature_grid", PRED + ", t AS (SELECT unnest([0.5, 1.0, 2.0])::DOUBLE AS temp), x AS (SELECT temp, 1 / (1 + exp(-(2 * confidence - 1) / temp)) AS q, gold = pred AS good FROM p, t) SELECT temp, round(avg(-ln(CASE WHEN good THEN q ELSE 1 - q END)), 6) AS nll FROM x GROUP BY temp")
def nll_temperature_grid(spark, sf_dir):
    grid = F.explode(F.array(*(F.lit(t) for t in (0.5, 1.0, 2.0)))).alias("temp")
    q = 1 / (1 + F.exp(-(2 * F.col("confidence") - 1) / F.col("temp")))
    p = predictions(spark, sf_dir).select("*", grid)
    return p.groupBy("temp").agg(F.round(F.avg(-F.log(F.when(F.col("gold") == F.col("pred"), q).otherwise(1 - q))), 6).alias("nll"))


@query("delta_vs_baseline", PRED + ", m AS (SELECT lang, avg((gold = pred)::INT) AS acc FROM p GROUP BY lang), b AS (SELECT lang, greatest(avg(gold), 1 - avg(gold)) AS base FROM p GROUP BY lang) SELECT lang, round(acc - base, 6) AS delta FROM m JOIN b USING (lang)")
def delta_vs_baseline(spark, sf_dir):
    share = F.avg("gold")
    m = predictions(spark, sf_dir).groupBy("lang").agg(F.avg((F.col("gold") == F.col("pred")).cast("int")).alias("acc"), F.greatest(share, 1 - share).alias("base"))
    return m.select("lang", F.round(F.col("acc") - F.col("base"), 6).alias("delta"))


@query("bio_runs", "WITH t AS (SELECT user_id, event_id, ts, event_type, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, event_type, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM t) SELECT user_id, run, min(event_type) AS event_type, count(*) AS n FROM s GROUP BY user_id, run HAVING count(*) > 1")
def bio_runs(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("new", F.when(F.col("event_type") == F.lag("event_type").over(w), 0).otherwise(1))
    e = e.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("user_id", "run").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n")).filter("n > 1")


@query("events_sliding", "SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([b, b - 3600]) AS start FROM (SELECT event_type, (floor(epoch(ts) / 3600) * 3600)::BIGINT AS b FROM events)) GROUP BY ALL")
def events_sliding(spark, sf_dir):
    return windows.tumbling(table(spark, sf_dir, "events"), "2 hours", "1 hour").select(F.unix_timestamp("start").alias("start"), "event_type", "n")


@query("shingle_overlap", "WITH s AS (SELECT item_id, list_distinct(list_transform(range(1, length(text) - 3), lambda i: substr(lower(text), i, 5))) AS g FROM benchmark) SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))), 6) AS j FROM s a JOIN s b ON a.item_id < b.item_id WHERE len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))) >= 0.03")
def shingle_overlap(spark, sf_dir):
    s = table(spark, sf_dir, "benchmark").select("item_id", char_shingles(F.lower("text")).alias("g"))
    g = s.select("item_id", F.size("g").alias("n"), F.explode("g").alias("x"))
    other = g.select(F.col("item_id").alias("b"), F.col("n").alias("m"), "x")
    # items that share no shingle never meet
    both = g.withColumnRenamed("item_id", "a").join(other, "x").filter("a < b").groupBy("a", "b", "n", "m").agg(F.count("*").alias("common"))
    j = F.col("common") / (F.col("n") + F.col("m") - F.col("common"))
    return both.select("a", "b", j.alias("j")).filter("j >= 0.03").select("a", "b", F.round("j", 6).alias("j"))


@query("content_terms_top", r"SELECT lang, term, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS r FROM (SELECT lang, term, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents) WHERE length(term) >= 4 GROUP BY ALL)) WHERE r <= 10")
def content_terms_top(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("lang", F.explode(tokens(F.col("text"))).alias("term")).filter(F.length("term") >= 4)
    n = t.groupBy("lang", "term").agg(F.count("*").alias("n"))
    return n.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "term"))).filter("r <= 10").drop("r")
