"""Metric queries. Predictions are derived from labels by hash arithmetic that both engines share."""

from __future__ import annotations

from pyspark.sql import functions as F

from veristrata.operators import metrics as M
from veristrata.registry import query, table

PRED = """WITH h AS (SELECT l.doc_id AS id, quality AS gold, lang, ('0x' || substr(md5(l.doc_id::VARCHAR), 1, 7))::BIGINT AS h FROM labels l JOIN documents USING (doc_id)), p AS (SELECT id, lang, gold, CASE WHEN h % 10 < 7 THEN gold ELSE 1 - gold END AS pred, (h // 10) % 1000 / 1000.0 AS confidence FROM h)"""
PER = PRED + """, k AS (SELECT DISTINCT lang, label FROM p, (VALUES (0), (1)) t(label)), s AS (SELECT k.lang, label, sum(CASE WHEN gold = label AND pred = label THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN pred = label THEN 1 ELSE 0 END) AS np, sum(CASE WHEN gold = label THEN 1 ELSE 0 END) AS ng FROM k JOIN p ON k.lang = p.lang GROUP BY k.lang, label), f AS (SELECT *, CASE WHEN np = 0 THEN 0 ELSE tp / np END AS precision, CASE WHEN ng = 0 THEN 0 ELSE tp / ng END AS recall FROM s), g AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM f)"""


def predictions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    h = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 7), 16, 10).cast("bigint")
    rows = table(spark, sf_dir, "labels").join(docs, "doc_id").select(F.col("doc_id").alias("id"), "lang", F.col("quality").alias("gold"), h.alias("h"))
    return rows.select("id", "lang", "gold", F.when(F.col("h") % 10 < 7, F.col("gold")).otherwise(1 - F.col("gold")).alias("pred"), (F.floor(F.col("h") / 10) % 1000 / 1000.0).alias("confidence"))


def labels(spark):
    return spark.createDataFrame([(0,), (1,)], "label int")


@query("confusion", PRED + " SELECT g.l AS gold, q.l AS pred, count(p.id) AS n FROM (VALUES (0), (1)) g(l) CROSS JOIN (VALUES (0), (1)) q(l) LEFT JOIN p ON p.gold = g.l AND p.pred = q.l GROUP BY ALL")
def confusion(spark, sf_dir):
    return M.confusion(predictions(spark, sf_dir), labels(spark)).select("gold", "pred", "n")


@query("per_class", PER + " SELECT lang, label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, ng::BIGINT AS support FROM g")
def per_class(spark, sf_dir):
    r = M.per_class(predictions(spark, sf_dir), labels(spark), ["lang"])
    return r.select("lang", "label", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "support")


@query("macro_f1_breakdown", PER + " SELECT lang, round(avg(f1), 6) AS macro_f1 FROM g GROUP BY lang")
def macro_f1_breakdown(spark, sf_dir):
    return M.macro_f1(predictions(spark, sf_dir), labels(spark), ["lang"]).select("lang", F.round("macro_f1", 6).alias("macro_f1"))


@query("wilson", PRED + ", a AS (SELECT lang, count(*) AS n, sum((gold = pred)::INT) AS hits FROM p GROUP BY lang), b AS (SELECT *, hits / n AS q, 1.959964 AS z FROM a) SELECT lang, n, round(greatest(0, (q + z*z/(2*n) - z*sqrt(q*(1-q)/n + z*z/(4*n*n))) / (1 + z*z/n)), 6) AS lo, round(least(1, (q + z*z/(2*n) + z*sqrt(q*(1-q)/n + z*z/(4*n*n))) / (1 + z*z/n)), 6) AS hi FROM b")
def wilson(spark, sf_dir):
    a = predictions(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), F.sum((F.col("gold") == F.col("pred")).cast("int")).alias("hits"))
    lo, hi = M.wilson(F.col("hits"), F.col("n"))
    return a.select("lang", "n", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


@query("false_label_rate", PRED + " SELECT round(sum((pred = 1)::INT) / count(*), 6) AS rate, count(*) AS n FROM p WHERE gold <> 1")
def false_label_rate(spark, sf_dir):
    return predictions(spark, sf_dir).filter("gold <> 1").agg(F.round(F.avg((F.col("pred") == 1).cast("int")), 6).alias("rate"), F.count("*").alias("n"))


RELIABILITY = PRED + ", r AS (SELECT least(floor(confidence * 10), 9)::BIGINT AS bin, count(*) AS n, avg((gold = pred)::INT) AS accuracy, avg(confidence) AS mean_confidence FROM p GROUP BY 1)"


@query("reliability", RELIABILITY + " SELECT bin, n, round(accuracy, 6) AS accuracy, round(mean_confidence, 6) AS mean_confidence FROM r")
def reliability(spark, sf_dir):
    r = M.reliability(predictions(spark, sf_dir))
    return r.select(F.col("bin").cast("bigint").alias("bin"), "n", F.round("accuracy", 6).alias("accuracy"), F.round("mean_confidence", 6).alias("mean_confidence"))


@query("ece", RELIABILITY + " SELECT round(sum(n * abs(accuracy - mean_confidence)) / sum(n), 6) AS ece FROM r")
def ece(spark, sf_dir):
    return M.ece(predictions(spark, sf_dir)).select(F.round("ece", 6).alias("ece"))


CURVE = PRED + ", o AS (SELECT row_number() OVER w AS pos, sum((gold = pred)::INT) OVER w AS hits FROM p WINDOW w AS (ORDER BY confidence DESC, id)), c AS (SELECT point, pos / (SELECT count(*) FROM p) AS coverage, hits / pos AS accuracy FROM (SELECT i AS point, greatest(1, ceil(i / 20 * (SELECT count(*) FROM p)))::BIGINT AS pos FROM range(21) t(i)) JOIN o USING (pos))"


@query("coverage_curve", CURVE + " SELECT point, round(coverage, 6) AS coverage, round(accuracy, 6) AS accuracy FROM c")
def coverage_curve(spark, sf_dir):
    return M.coverage_curve(predictions(spark, sf_dir)).select("point", F.round("coverage", 6).alias("coverage"), F.round("accuracy", 6).alias("accuracy"))


@query("aucc", CURVE + ", t AS (SELECT coverage, accuracy, lead(coverage) OVER (ORDER BY point) AS c2, lead(accuracy) OVER (ORDER BY point) AS a2 FROM c) SELECT round(sum((c2 - coverage) * (accuracy + a2) / 2) / (max(coalesce(c2, coverage)) - min(coverage)), 6) AS aucc FROM t")
def aucc(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.orderBy("point")  # 21 rows
    t = M.coverage_curve(predictions(spark, sf_dir)).select("coverage", "accuracy", F.lead("coverage").over(w).alias("c2"), F.lead("accuracy").over(w).alias("a2"))
    area = F.sum((F.col("c2") - F.col("coverage")) * (F.col("accuracy") + F.col("a2")) / 2)
    return t.agg(F.round(area / (F.max("coverage") - F.min("coverage")), 6).alias("aucc"))


@query("selective_tau", PRED + ", t AS (SELECT unnest([0.3, 0.5, 0.7, 0.9])::DOUBLE AS tau) SELECT tau, count(*) FILTER (confidence >= tau) AS answered, round(avg((gold = pred)::INT) FILTER (confidence >= tau), 6) AS accuracy FROM p, t GROUP BY tau")
def selective_tau(spark, sf_dir):
    taus = F.explode(F.array(*(F.lit(x) for x in (0.3, 0.5, 0.7, 0.9)))).alias("tau")
    shown = F.col("confidence") >= F.col("tau")
    return predictions(spark, sf_dir).select("*", taus).groupBy("tau").agg(F.sum(shown.cast("bigint")).alias("answered"), F.round(F.avg(F.when(shown, (F.col("gold") == F.col("pred")).cast("int"))), 6).alias("accuracy"))


@query("operating_point", PRED + ", d AS (SELECT confidence AS tau, count(*) AS n FROM p GROUP BY 1), s AS (SELECT tau, sum(n) OVER (ORDER BY tau DESC) AS answered FROM d) SELECT min(tau) AS tau FROM s WHERE answered <= 0.3 * (SELECT count(*) FROM p)")
def operating_point(spark, sf_dir):
    from pyspark.sql import Window

    p = predictions(spark, sf_dir)
    d = p.groupBy(F.col("confidence").alias("tau")).agg(F.count("*").alias("n"))  # at most 1000 values
    s = d.withColumn("answered", F.sum("n").over(Window.orderBy(F.desc("tau")))).crossJoin(p.agg(F.count("*").alias("total")))
    return s.filter(F.col("answered") <= 0.3 * F.col("total")).agg(F.min("tau").alias("tau"))


@query("cer_by_lang", "SELECT lang, round(sum(len(list_filter(string_split(text, ''), lambda c: lower(c) <> c))) / sum(length(text)), 6) AS cer FROM documents GROUP BY lang")
def cer_by_lang(spark, sf_dir):
    edits = M.lowering_edits("text").alias("edits")
    return table(spark, sf_dir, "documents").select("lang", edits, F.length("text").alias("n")).groupBy("lang").agg(F.round(F.sum("edits") / F.sum("n"), 6).alias("cer"))
