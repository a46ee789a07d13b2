"""Verdict queries. Events stand in for passages: a user's events are a claim's passages, scores derived from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from veristrata.operators import decisions as D
from veristrata.registry import query, table

PASSAGES = "WITH p AS (SELECT user_id AS claim, event_id % 97 / 200.0 AS support, event_id % 89 / 190.0 AS refute, event_id % 11 / 10.0 AS relevance FROM events)"


def passages(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("claim"), e.alias("passage"), (e % 97 / 200.0).alias("support"), (e % 89 / 190.0).alias("refute"), (e % 11 / 10.0).alias("relevance"))


@query(
    "rule_verdict",
    """WITH m AS (SELECT c_custkey AS claim, max(event_id % 97 / 192.0) AS s, max(event_id % 89 / 176.0) AS r FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY claim)
    SELECT claim, CASE WHEN s >= 0.5 AND r >= 0.5 THEN 'Conflicting' WHEN s >= 0.5 THEN 'Supported' WHEN r >= 0.5 THEN 'Refuted' ELSE 'NEI' END AS verdict,
    round(CASE WHEN s IS NULL THEN 0 WHEN s >= 0.5 OR r >= 0.5 THEN greatest(s, r) ELSE 1 - greatest(s, r) END, 6) AS confidence FROM m""",
)
def rule_verdict(spark, sf_dir):
    # every customer is a claim; scores end at 0.5, so that some claims reach the limit on either side
    e = F.col("event_id")
    p = table(spark, sf_dir, "events").select(F.col("user_id").alias("claim"), (e % 97 / 192.0).alias("support"), (e % 89 / 176.0).alias("refute"))
    claims = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("claim"))
    return D.rule_verdict(p, "claim", claims).withColumn("confidence", F.round("confidence", 6))


@query("live_verdict", PASSAGES + ", m AS (SELECT claim, sum(relevance * support) / nullif(sum(relevance), 0) AS s, sum(relevance * refute) / nullif(sum(relevance), 0) AS r, max(refute) AS most FROM p GROUP BY claim) SELECT claim, CASE WHEN s IS NULL THEN 'NEI' WHEN least(s, r) >= 0.25 AND least(s, r) >= 0.6 * greatest(s, r) THEN 'Conflicting' WHEN greatest(s, r) > 1 - s - r THEN CASE WHEN s < r THEN 'Refuted' WHEN most >= 0.5 THEN 'Conflicting' ELSE 'Supported' END ELSE 'NEI' END AS verdict FROM m")
def live_verdict(spark, sf_dir):
    return D.live_verdict(passages(spark, sf_dir), "claim", "passage")


@query(
    "softmax_temperature",
    """WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
    e AS (SELECT *, exp(v / 0.7) / sum(exp(v / 0.7)) OVER (PARTITION BY vec_id) AS p FROM x)
    SELECT label, i::BIGINT AS class, round(avg(p), 6) AS p FROM e GROUP BY label, i""",
)
def softmax_temperature(spark, sf_dir):
    p = D.softmax(F.transform("embedding", lambda x: x.cast("double")), 0.7)
    each = table(spark, sf_dir, "embeddings").select("label", F.posexplode(p).alias("i", "p"))
    return each.groupBy("label", (F.col("i") + 1).cast("bigint").alias("class")).agg(F.round(F.avg("p"), 6).alias("p"))


@query("confidence_bands", "SELECT CASE WHEN c >= 0.6 THEN 'high' WHEN c >= 0.4 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM (SELECT event_id % 100 / 100.0 AS c FROM events) GROUP BY band")
def confidence_bands(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(D.band(F.col("event_id") % 100 / 100.0).alias("band")).agg(F.count("*").alias("n"))
