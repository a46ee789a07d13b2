"""Queries of pooled and hybrid retrieval, matching, routing, agreement, baselines, splits and guards."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veristrata.functions import text as T
from veristrata.operators import decisions as D
from veristrata.operators import metrics as M
from veristrata.operators import retrieval as R
from veristrata.plans.decisions import PASSAGES, passages
from veristrata.plans.metrics import PRED, predictions
from veristrata.plans.retrieval import BM25_SQL, COS, bm25_ranked
from veristrata.registry import query, table

POOL = "CASE item_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' ELSE 'es' END"


@query(
    "bm25_pool_topk",
    rf"""WITH w AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS ws FROM documents), p AS (SELECT doc_id, lang, term, dl, count(*) AS tf FROM (SELECT doc_id, lang, unnest(ws) AS term, len(ws) AS dl FROM w) GROUP BY ALL),
    s AS (SELECT lang, count(*) AS n, avg(len(ws)) AS avgdl FROM w GROUP BY lang), d AS (SELECT lang, term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM p JOIN s USING (lang) GROUP BY lang, term, n),
    a AS (SELECT lang, avg(idf) AS mean_idf FROM d GROUP BY lang), f AS (SELECT lang, term, CASE WHEN idf < 0 THEN 0.25 * mean_idf ELSE idf END AS idf FROM d JOIN a USING (lang)),
    q AS (SELECT item_id, lang, term, count(*) AS qtf FROM (SELECT item_id, {POOL} AS lang, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS term FROM benchmark) GROUP BY ALL),
    h AS (SELECT item_id, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN p USING (lang, term) JOIN f USING (lang, term) JOIN s USING (lang) GROUP BY ALL),
    e AS (SELECT item_id, doc_id, coalesce(round(score, 6), 0) AS score FROM (SELECT item_id, {POOL} AS lang FROM benchmark) JOIN documents USING (lang) LEFT JOIN h USING (item_id, doc_id))
    SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM e) WHERE rank <= 10""",
)
def bm25_pool_topk(spark, sf_dir):
    """R-01."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    asked = table(spark, sf_dir, "benchmark").select("item_id", "text", F.expr(POOL).alias("lang"))
    return R.pool_topk(docs, asked, "item_id", "doc_id", "lang", 10).select("item_id", "doc_id", "score", F.col("rank").cast("bigint").alias("rank"))


VECTORS = f"""v AS (SELECT a.vec_id AS item_id, b.vec_id AS doc_id, round({COS}, 6) AS cos FROM embeddings a JOIN benchmark ON a.vec_id = item_id JOIN embeddings b ON a.vec_id <> b.vec_id),
x AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY cos DESC, doc_id) AS rank FROM v)"""


def vectors(spark, sf_dir):
    """Cosines of the items' vectors (of the same number) with all others."""
    e = table(spark, sf_dir, "embeddings")
    asked = e.join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id")).distinct(), "vec_id", "left_semi")
    return R.dense(asked, e).select(F.col("query_id").alias("item_id"), F.col("vec_id").alias("doc_id"), F.round("score", 6).alias("cos"))


@query(
    "corpus_hybrid",
    BM25_SQL + ", " + VECTORS + """, u AS (SELECT item_id, doc_id, rank FROM r WHERE rank <= 50 AND score > 0 UNION ALL SELECT item_id, doc_id, rank FROM x WHERE rank <= 50), g AS (SELECT item_id, doc_id, round(sum(1.0 / (60 + rank)), 8) AS score FROM u GROUP BY ALL)
    SELECT item_id, doc_id, score, cos AS dense_score, pos FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS pos FROM g) LEFT JOIN v USING (item_id, doc_id) WHERE pos <= 10""",
)
def corpus_hybrid(spark, sf_dir):
    """R-05, R-07, R-08: the best 50 by BM25 (scores over 0 only) and by cosine, fused; the cosine stands beside each hit."""
    cos = vectors(spark, sf_dir)
    words = bm25_ranked(spark, sf_dir, 50).filter("score > 0").select("item_id", "doc_id", "rank")
    dense = R.top_k(cos, ["item_id"], "doc_id", 50, "cos").select("item_id", "doc_id", "rank")
    fused = R.rrf(words.unionByName(dense), "item_id", "doc_id").withColumn("score", F.round("score", 8))
    best = R.top_k(fused, ["item_id"], "doc_id", 10).withColumn("pos", F.col("rank").cast("bigint"))
    return best.join(cos, ["item_id", "doc_id"], "left").select("item_id", "doc_id", "score", F.col("cos").alias("dense_score"), "pos")


@query(
    "dense_fuse",
    BM25_SQL + ", " + VECTORS + """, b AS (SELECT item_id, doc_id, rank, count(*) OVER (PARTITION BY item_id) AS n FROM r WHERE rank <= 20)
    SELECT item_id, doc_id, round(coalesce(cos, -2 - (rank - 1) / (n + 1)), 6) AS score FROM b LEFT JOIN v USING (item_id, doc_id)""",
)
def dense_fuse(spark, sf_dir):
    """R-06: BM25's best by cosine; documents without a vector behind all others, in BM25's order."""
    b = bm25_ranked(spark, sf_dir, 20).withColumn("n", F.count("*").over(Window.partitionBy("item_id")))
    return b.join(vectors(spark, sf_dir), ["item_id", "doc_id"], "left").select("item_id", "doc_id", F.round(F.coalesce("cos", -2 - (F.col("rank") - 1) / (F.col("n") + 1)), 6).alias("score"))


@query("rerank_sort", BM25_SQL + " SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id * 7919 % 101 DESC, doc_id) AS rank FROM r WHERE rank <= 10")
def rerank_sort(spark, sf_dir):
    """R-10: a second scorer (a stand-in by doc_id) puts the candidates in a new order."""
    scored = bm25_ranked(spark, sf_dir).select("item_id", "doc_id", (F.col("doc_id") * 7919 % 101).alias("score"))
    return R.top_k(scored, ["item_id"], "doc_id", 10).select("item_id", "doc_id", F.col("rank").cast("bigint").alias("rank"))


@query(
    "match_or_similar",
    BM25_SQL + """ SELECT item_id, r.doc_id, CASE WHEN round(score, 4) >= 60 AND quality IS NOT NULL THEN 'match' WHEN round(score, 4) >= 30 AND url IS NOT NULL THEN 'similar' ELSE 'none' END AS kind, CASE WHEN round(score, 4) >= 30 THEN url END AS url
    FROM r LEFT JOIN labels l USING (doc_id) LEFT JOIN pages ON page_id = r.doc_id WHERE rank = 1""",
)
def match_or_similar(spark, sf_dir):
    """R-11, R-12, R-16, J-06, F-01: the best hit is a match (it needs a verdict), a similar one (it needs a link), or none."""
    best = bm25_ranked(spark, sf_dir, 1).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    best = best.join(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url"), "doc_id", "left")
    s = F.round("score", 4)
    kind = F.when((s >= 60) & F.col("quality").isNotNull(), "match").when((s >= 30) & F.col("url").isNotNull(), "similar").otherwise("none")
    return best.select("item_id", "doc_id", kind.alias("kind"), F.when(s >= 30, F.col("url")).alias("url"))


@query("training_pairs", BM25_SQL + ", g AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), n AS (SELECT item_id, doc_id FROM r WHERE rank <= 10) SELECT item_id, doc_id, 1 AS label FROM g UNION ALL SELECT item_id, doc_id, 0 FROM n ANTI JOIN g USING (item_id, doc_id)")
def training_pairs(spark, sf_dir):
    """R-15: all gold documents as 1, the best others as 0. Gold is among documents that hold an item's rarest word, then checked whole."""
    items, docs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents").select("doc_id", "text")
    held = docs.select("doc_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    asked = items.select("item_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    df = held.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    rare = asked.join(df, "term").groupBy("item_id").agg(F.min_by("term", F.struct("df", "term")).alias("term"))
    near = rare.join(held, "term").join(items, "item_id").join(docs.withColumnRenamed("text", "d"), "doc_id")
    gold = near.filter(F.contains("d", "text")).select("item_id", "doc_id")
    others = bm25_ranked(spark, sf_dir).select("item_id", "doc_id").join(gold, ["item_id", "doc_id"], "left_anti")
    return gold.withColumn("label", F.lit(1)).unionByName(others.withColumn("label", F.lit(0)))


LIVE = """, m AS (SELECT claim, sum(relevance * support) / nullif(sum(relevance), 0) AS s, sum(relevance * refute) / nullif(sum(relevance), 0) AS r, max(refute) AS most FROM p GROUP BY claim),
d AS (SELECT claim, s, r, 1 - s - r AS u, CASE WHEN s IS NULL THEN 'NEI' WHEN least(s, r) >= 0.25 AND least(s, r) >= 0.6 * greatest(s, r) THEN 'Conflicting' WHEN greatest(s, r) > 1 - s - r THEN CASE WHEN s < r THEN 'Refuted' WHEN most >= 0.5 THEN 'Conflicting' ELSE 'Supported' END ELSE 'NEI' END AS verdict FROM m),
l AS (SELECT claim, verdict, CASE WHEN s IS NULL THEN 0 WHEN verdict = 'Conflicting' THEN least(1, s + r) WHEN verdict = 'Supported' THEN s WHEN verdict = 'Refuted' THEN r ELSE u END AS confidence FROM d)"""


@query("live_confidence", PASSAGES + LIVE + " SELECT claim, verdict, round(confidence, 6) AS confidence FROM l")
def live_confidence(spark, sf_dir):
    """V-03 with the confidence of each branch."""
    return D.live_scored(passages(spark, sf_dir), "claim", "passage").withColumn("confidence", D.rounded(F.col("confidence"), 6))


TWO = PASSAGES + LIVE + """, p2 AS (SELECT user_id AS claim, event_id % 83 / 170.0 AS support, event_id % 89 / 190.0 AS refute, event_id % 11 / 10.0 AS relevance FROM events)""" + LIVE.replace(" m AS", " m2 AS").replace("FROM p GROUP", "FROM p2 GROUP").replace("d AS (", "d2 AS (").replace("FROM m)", "FROM m2)").replace("l AS (", "l2 AS (").replace("FROM d)", "FROM d2)")


def second(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("claim"), e.alias("passage"), (e % 83 / 170.0).alias("support"), (e % 89 / 190.0).alias("refute"), (e % 11 / 10.0).alias("relevance"))


@query("two_model_agree", TWO + " SELECT claim, CASE WHEN l.verdict = l2.verdict AND l.verdict IN ('Supported', 'Refuted') THEN l.verdict ELSE 'NEI' END AS verdict, round(least(l.confidence, l2.confidence), 6) AS confidence, NOT (l.verdict = l2.verdict AND l.verdict IN ('Supported', 'Refuted')) AS abstained FROM l JOIN l2 USING (claim)")
def two_model_agree(spark, sf_dir):
    """V-04, J-16: two scorers' verdicts of a claim, kept where they agree on a side."""
    a = D.live_scored(passages(spark, sf_dir), "claim", "passage")
    b = D.live_scored(second(spark, sf_dir), "claim", "passage").select("claim", F.col("verdict").alias("v"), F.col("confidence").alias("c"))
    same = (F.col("verdict") == F.col("v")) & F.col("verdict").isin("Supported", "Refuted")
    return a.join(b, "claim").select("claim", F.when(same, F.col("verdict")).otherwise("NEI").alias("verdict"), D.rounded(F.least("confidence", "c"), 6).alias("confidence"), (~same).alias("abstained"))


@query(
    "route_paths",
    PASSAGES + LIVE + """, b AS (SELECT user_id AS claim, max(event_id % 101 / 95.0) AS fast FROM events GROUP BY 1)
    SELECT claim, CASE WHEN fast >= 1.04 THEN 'fast' WHEN confidence >= 0.3 AND verdict <> 'NEI' THEN 'evidence' ELSE 'none' END AS path, CASE WHEN fast >= 1.04 THEN 'Refuted' WHEN confidence >= 0.3 AND verdict <> 'NEI' THEN verdict ELSE 'NEI' END AS shown,
    round(CASE WHEN fast >= 1.04 THEN least(greatest(fast, 0), 1) ELSE confidence END, 6) AS confidence FROM l JOIN b USING (claim)""",
)
def route_paths(spark, sf_dir):
    """V-05, V-07, V-08, F-01: a fast match first, then evidence of enough confidence, else nothing; confidence within 0 and 1."""
    fast = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("claim")).agg(F.max(F.col("event_id") % 101 / 95.0).alias("fast"))
    j = D.live_scored(passages(spark, sf_dir), "claim", "passage").join(fast, "claim")
    f, ok = F.col("fast") >= 1.04, (F.col("confidence") >= 0.3) & (F.col("verdict") != "NEI")
    shown = F.when(f, "Refuted").when(ok, F.col("verdict")).otherwise("NEI")
    sure = F.when(f, F.least(F.greatest("fast", F.lit(0.0)), F.lit(1.0))).otherwise(F.col("confidence"))
    return j.select("claim", F.when(f, "fast").when(ok, "evidence").otherwise("none").alias("path"), shown.alias("shown"), D.rounded(sure, 6).alias("confidence"))


@query(
    "faithfulness_gate",
    """WITH s AS (SELECT user_id, event_type AS sentence, max(event_id % 97 / 96.0) AS best, count(*) FILTER (event_id % 97 / 96.0 >= 0.5) AS supporting FROM events GROUP BY ALL)
    SELECT user_id, count(*) AS sentences, sum(supporting)::BIGINT AS supporting, min(best) >= 0.5 AS faithful, round(avg(best), 6) AS mean_best FROM s GROUP BY user_id""",
)
def faithfulness_gate(spark, sf_dir):
    """V-09, V-10, J-17, M-24: an explanation is faithful if every sentence is entailed by a passage; event types stand in for sentences."""
    p = F.col("event_id") % 97 / 96.0
    s = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max(p).alias("best"), F.count(F.when(p >= 0.5, 1)).alias("supporting"))
    return s.groupBy("user_id").agg(F.count("*").alias("sentences"), F.sum("supporting").alias("supporting"), (F.min("best") >= 0.5).alias("faithful"), F.round(F.avg("best"), 6).alias("mean_best"))


@query(
    "baselines",
    PRED + """, m AS (SELECT lang, gold, count(*) AS n FROM p GROUP BY ALL), g AS (SELECT lang, arg_min(gold, (-n, gold)) AS major FROM m GROUP BY lang), y AS (SELECT *, ('0x' || substr(md5('42:' || id), 1, 12))::BIGINT / 281474976710656.0 AS u FROM p), t AS (SELECT avg(gold) AS one FROM p)
    SELECT lang, round(avg((gold = major)::INT), 6) AS majority_class, round(avg((gold = (u < one)::INT)::INT), 6) AS stratified_random, round(avg((gold = 1)::INT), 6) AS always_one FROM y JOIN g USING (lang), t GROUP BY lang""",
)
def baselines(spark, sf_dir):
    """BL-1, BL-2: the most frequent class of a language, and a class drawn by its share (by hash, seed 42)."""
    p = predictions(spark, sf_dir)
    n = p.groupBy("lang", "gold").agg(F.count("*").alias("n"))
    major = n.groupBy("lang").agg(F.min_by("gold", F.struct(-F.col("n"), "gold")).alias("major"))
    u = F.conv(F.substring(F.md5(F.concat(F.lit("42:"), F.col("id").cast("string"))), 1, 12), 16, 10).cast("bigint") / float(2**48)
    j = p.join(F.broadcast(major), "lang").crossJoin(F.broadcast(p.agg(F.avg("gold").alias("one"))))
    hit = lambda c: F.round(F.avg((F.col("gold") == c).cast("int")), 6)
    return j.groupBy("lang").agg(hit(F.col("major")).alias("majority_class"), hit((u < F.col("one")).cast("int")).alias("stratified_random"), hit(F.lit(1)).alias("always_one"))


@query("random_rank", "SELECT item_id, doc_id, rank FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY md5('42:' || item_id || ':' || doc_id), doc_id) AS rank FROM benchmark, documents) WHERE rank <= 5")
def random_rank(spark, sf_dir):
    """BL-3, R-09: five documents of each stated item by a seeded hash; tasks keep five of each before the shuffle."""
    both = table(spark, sf_dir, "documents").select("doc_id").join(F.broadcast(table(spark, sf_dir, "benchmark").select("item_id")), F.lit(True))
    key = F.md5(F.concat_ws(":", F.lit("42"), F.col("item_id").cast("string"), F.col("doc_id").cast("string")))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(key, "doc_id")).cast("bigint")).filter("rank <= 5")


LONGEST = r"""WITH s AS (SELECT doc_id, unnest(x) AS sentence, generate_subscripts(x, 1) AS pos FROM (SELECT doc_id, list_transform(regexp_split_to_array(text, '[.!?।\n]+'), lambda x: trim(x)) AS x FROM documents))"""


@query("longest_sentence", LONGEST + " SELECT doc_id, arg_min(sentence, (-length(sentence), pos)) AS sentence FROM s WHERE sentence <> '' GROUP BY doc_id")
def longest_sentence(spark, sf_dir):
    """BL-6: the first of a document's longest sentences."""
    s = F.filter(F.transform(F.split("text", r"[.!?।\n]+"), lambda x: F.trim(x)), lambda x: x != "")
    first = F.aggregate(s, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    return table(spark, sf_dir, "documents").select("doc_id", first.alias("sentence")).filter("sentence <> ''")


@query("extractive_explanation", LONGEST + " SELECT doc_id, string_agg(sentence, '. ' ORDER BY pos) AS explanation FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM s WHERE sentence <> '') WHERE r <= 2 GROUP BY doc_id")
def extractive_explanation(spark, sf_dir):
    """BL-8, T-05: the first two sentences in their order."""
    s = F.filter(F.transform(F.split("text", r"[.!?।\n]+"), lambda x: F.trim(x)), lambda x: x != "")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.slice(s, 1, 2), ". ").alias("explanation")).filter("explanation <> ''")


@query(
    "guards",
    PRED + """, x AS (SELECT *, CASE WHEN id % 50 = 0 THEN 1.5 ELSE confidence END AS c2 FROM p),
    r AS (SELECT user_id, event_id % 97 / 97.0 AS s, lag(event_id % 97 / 97.0) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
    SELECT 'schema' AS guard, count(*) AS violations FROM documents WHERE lang NOT IN ('en', 'hi', 'pa') OR source IS NULL
    UNION ALL SELECT 'unique_id', count(*) FROM (SELECT sha1(text) FROM documents GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'coverage', count(*) FROM documents ANTI JOIN labels USING (doc_id)
    UNION ALL SELECT 'labels', count(*) FROM labels WHERE quality NOT IN (0, 1)
    UNION ALL SELECT 'confidence_range', count(*) FROM x WHERE c2 NOT BETWEEN 0 AND 1
    UNION ALL SELECT 'monotone_scores', count(*) FROM r WHERE s > before
    UNION ALL SELECT 'row_counts', abs((SELECT count(*) FROM documents) - (SELECT count(*) FROM embeddings))""",
)
def guards(spark, sf_dir):
    """DQ-01, DQ-02, DQ-06 to DQ-09, DQ-13, W-09: rows that break each rule; none where all is well (here, many do)."""
    d, x = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    c = F.when(F.col("id") % 50 == 0, 1.5).otherwise(F.col("confidence"))
    s = F.col("event_id") % 97 / 97.0
    e = table(spark, sf_dir, "events").select(s.alias("s"), F.lag(s).over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("before"))
    broken = {
        "schema": d.filter(~F.col("lang").isin("en", "hi", "pa") | F.col("source").isNull()),
        "unique_id": d.groupBy(F.sha1("text")).count().filter("count > 1"),
        "coverage": d.join(x, "doc_id", "left_anti"),
        "labels": x.filter(~F.col("quality").isin(0, 1)),
        "confidence_range": predictions(spark, sf_dir).filter(~c.between(0, 1)),
        "monotone_scores": e.filter("s > before"),
    }
    counts = [rows.agg(F.lit(name).alias("guard"), F.count("*").alias("violations")) for name, rows in broken.items()]
    sizes = d.agg(F.count("*").alias("a")).crossJoin(table(spark, sf_dir, "embeddings").agg(F.count("*").alias("b")))
    out = sizes.select(F.lit("row_counts").alias("guard"), F.abs(F.col("a") - F.col("b")).alias("violations"))
    for c in counts:
        out = out.unionByName(c)
    return out


@query("renumber", "SELECT doc_id, lang || '-' || printf('%05d', row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) AS uid FROM documents")
def renumber(spark, sf_dir):
    """W-01: new ids by language, counted by ranges of doc_id."""
    return M.numbered(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["lang"], ["doc_id"]).select("doc_id", F.format_string("%s-%05d", "lang", F.col("number") - 1).alias("uid"))


@query("prefix_truncation", "SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS total FROM conversations) WHERE total <= 400")
def prefix_truncation(spark, sf_dir):
    """W-07, N-42: a conversation's turns as long as their characters stay within 400."""
    total = F.sum(F.length("text")).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    return table(spark, sf_dir, "conversations").withColumn("total", total).filter("total <= 400").select("conv_id", "turn")


@query("publisher_cap", "SELECT page_id, publisher FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(url), '^[a-z]+://', ''), '[/?#].*$', ''), '^www\\.', '') AS publisher, row_number() OVER (PARTITION BY publisher ORDER BY page_id) AS r FROM pages) WHERE r <= 2")
def publisher_cap(spark, sf_dir):
    """W-10: a publisher's first two pages."""
    p = table(spark, sf_dir, "pages").select("page_id", T.publisher(F.col("url")).alias("publisher"))
    return R.top_k(p.withColumn("score", F.lit(0)), ["publisher"], "page_id", 2).select("page_id", "publisher")


@query("gold_or_fold", "SELECT text_sha1, min(doc_id) AS doc_id, bool_or(gold) AS is_gold FROM (SELECT sha1(text) AS text_sha1, doc_id, coalesce(quality = 1, false) AS gold FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY text_sha1")
def gold_or_fold(spark, sf_dir):
    """A-07, O-04, J-02: of equal texts the first, gold if any of them is."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha1("text").alias("text_sha1")).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return d.groupBy("text_sha1").agg(F.min("doc_id").alias("doc_id"), F.bool_or(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("is_gold"))


@query("span_overlap", "WITH t AS (SELECT user_id, event_id AS s, event_id + 40 AS e FROM events WHERE event_type = 'click'), c AS (SELECT user_id, event_id AS lo, event_id + 25 AS hi FROM events WHERE event_type <> 'click') SELECT user_id, count(*) AS n FROM t JOIN c USING (user_id) WHERE s < hi AND e > lo GROUP BY user_id")
def span_overlap(spark, sf_dir):
    """J-14: spans of a user that overlap; both sides meet in the buckets of 64 that they touch, counted in the first they share."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    touch = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / 64), F.floor(F.col(hi) / 64))).alias("bucket")
    t = e.filter("event_type = 'click'").select("user_id", i.alias("s"), (i + 40).alias("e")).select("*", touch("s", "e"))
    c = e.filter("event_type <> 'click'").select("user_id", i.alias("lo"), (i + 25).alias("hi")).select("*", touch("lo", "hi"))
    met = t.join(c, ["user_id", "bucket"]).filter("s < hi AND e > lo AND bucket = floor(greatest(s, lo) / 64)")
    return met.groupBy("user_id").agg(F.count("*").alias("n"))


@query("label_index_agreement", "SELECT shift, round(avg((a.quality = b.quality)::INT), 6) AS agreement FROM labels a JOIN (SELECT unnest([-1, 0, 1]) AS shift) ON true JOIN labels b ON b.doc_id = a.doc_id + shift GROUP BY shift")
def label_index_agreement(spark, sf_dir):
    """L-13: agreement of two sides at index shifts of -1, 0 and 1."""
    x = table(spark, sf_dir, "labels").select("doc_id", "quality")
    a = x.select(F.col("quality").alias("q"), F.explode(F.array(*map(F.lit, (-1, 0, 1)))).alias("shift"), "doc_id").withColumn("doc_id", F.col("doc_id") + F.col("shift"))
    return a.join(x, "doc_id").groupBy("shift").agg(F.round(F.avg((F.col("q") == F.col("quality")).cast("int")), 6).alias("agreement"))
