"""Queries of samples, inherited splits, live evidence, selection rules and estimators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veristrata.functions import text as T
from veristrata.operators import evaluation as E
from veristrata.operators import learned as L
from veristrata.operators import metrics as M
from veristrata.operators import retrieval as R
from veristrata.operators import samples as S
from veristrata.plans.metrics import PRED, labels, predictions
from veristrata.registry import query, spelled, table

LABELLED = "WITH l AS (SELECT doc_id, quality, md5('42:' || doc_id) AS h FROM labels), r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY h, doc_id) AS n FROM l)"


@query(
    "samples_dealt",
    LABELLED + """, s AS (SELECT doc_id, quality, CASE WHEN n <= 5 THEN 'select' WHEN n <= 12 THEN 'confirm' ELSE 'fresh' END AS sample, CASE WHEN n <= 5 THEN n WHEN n <= 12 THEN n - 5 ELSE n - 12 END AS own FROM r WHERE n <= 20)
    SELECT doc_id, quality, sample, row_number() OVER (PARTITION BY sample ORDER BY own, quality) AS pos FROM s""",
)
def samples_dealt(spark, sf_dir):
    """L-10: three disjoint samples of 5, 7 and 8 documents a label."""
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return S.dealt(rows, "doc_id", "quality", {"select": 5, "confirm": 7, "fresh": 8}).select("doc_id", "quality", "sample", F.col("pos").cast("bigint").alias("pos"))


@query(
    "truth_relabel",
    "SELECT doc_id, CASE WHEN quality = 0 THEN CASE toxic WHEN 1 THEN 'Refuted' ELSE 'NEI' END ELSE 'Supported' END AS label FROM labels",
)
def truth_relabel(spark, sf_dir):
    """L-11: documents of label 0 take the truth of a second table."""
    rows = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 0, "NEI").otherwise("Supported").alias("label"))
    truth = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "F").otherwise("U").alias("truth"))
    return S.relabelled(rows, truth, "doc_id", "label", F.col("label") == "NEI", {"T": "Supported", "F": "Refuted", "U": "NEI"})


@query(
    "language_cap",
    """WITH r AS (SELECT doc_id, lang, doc_id % 5 > 0 AS made, row_number() OVER (PARTITION BY lang ORDER BY doc_id % 5 > 0, md5('42:' || doc_id), doc_id) AS n FROM documents) SELECT doc_id, lang, made FROM r WHERE n <= 30""",
)
def language_cap(spark, sf_dir):
    """L-12: thirty documents of a language, real ones (every fifth stands for one) first."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("doc_id") % 5 > 0).alias("made"))
    return S.capped(rows, "doc_id", "lang", "made", 30)


@query(
    "error_sample",
    PRED + """, w AS (SELECT *, count(*) OVER (PARTITION BY gold, pred) AS size, row_number() OVER (PARTITION BY gold, pred ORDER BY md5('42:' || id), id) AS n FROM p WHERE gold <> pred)
    SELECT id, gold, pred FROM w ORDER BY n, size DESC, gold || ',' || pred LIMIT 9""",
)
def error_sample(spark, sf_dir):
    """L-15: a report of nine wrong predictions, dealt over the kinds of errors."""
    return S.error_sample(predictions(spark, sf_dir).select("id", "gold", "pred"), 9)


@query("inherited_splits", "SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 10 < 8 THEN 'train' WHEN l_orderkey % 10 = 8 THEN 'dev' ELSE 'test' END AS split FROM lineitem WHERE l_orderkey % 7 > 0 AND l_orderkey IN (SELECT o_orderkey FROM orders)")
def inherited_splits(spark, sf_dir):
    """J-13, L-09: line items take the split of their order; those of orders without a split are dropped."""
    k = F.col("o_orderkey")
    split = F.when(k % 10 < 8, "train").when(k % 10 == 8, "dev").otherwise("test")
    orders = table(spark, sf_dir, "orders").filter(k % 7 > 0).select(F.concat(F.lit("set:train.json:"), k.cast("string")).alias("source_id"), split.alias("split"))
    own = F.concat_ws(":", F.lit("set_stance:train.json"), F.col("l_orderkey").cast("string"), F.lit("q0"), F.concat(F.lit("a"), F.col("l_linenumber").cast("string")))
    return S.inherited(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), orders, S.parent_id(own)).select("l_orderkey", "l_linenumber", "split")


@query("evidence_pools", "SELECT c_custkey AS claim, event_id FROM customer LEFT JOIN events ON user_id = c_custkey")
def evidence_pools(spark, sf_dir):
    """J-05: claims with the passages of their pool; claims whose pool is empty stay."""
    claims = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("claim"), F.concat(F.lit("set:dev.json:"), F.col("c_custkey").cast("string")).alias("source_id"))
    pools = table(spark, sf_dir, "events").select(F.lit("dev").alias("store"), F.col("user_id").cast("bigint").alias("claim_idx"), "event_id")
    return S.with_pools(claims, pools).select("claim", "event_id")


@query("accepted_pairs", "SELECT user_id AS a, event_id AS b FROM events WHERE NOT (user_id % 2 = 0 AND event_id % 3 = 0)")
def accepted_pairs(spark, sf_dir):
    """J-15: pairs that are not accepted; the list names the two in the other order."""
    pairs = table(spark, sf_dir, "events").select(F.lit("d").alias("dataset"), F.col("user_id").cast("bigint").alias("a"), "event_id").withColumnRenamed("event_id", "b")
    listed = pairs.filter("a % 2 = 0 AND b % 3 = 0").select("dataset", F.col("b").alias("a"), F.col("a").alias("b"))
    # a pair's mirror may stand among the pairs as one of its own
    return S.not_accepted(pairs, listed).select("a", "b")




@query(
    "span_convention",
    "SELECT count(*) AS n, count(*) FILTER (doc_id % 2 = 0) AS inclusive, count(*) FILTER (doc_id % 2 = 1) AS exclusive, count(*) FILTER (quality + 5 + doc_id % 2 < 7) AS inside FROM labels",
)
def span_convention(spark, sf_dir):
    """L-14: spans of `quality + 3` tokens from token 3; the end of those of even documents belongs to them."""
    q = F.col("quality") + 3
    return S.inclusive_ends(table(spark, sf_dir, "labels").select(F.lit(3).alias("start"), (q + 2 + F.col("doc_id") % 2).alias("stop"), q.alias("tokens"), F.lit(7).alias("text_tokens")))


@query("shard_rows", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 40 OFFSET 25")
def shard_rows(spark, sf_dir):
    """T-06."""
    return S.shard(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), [F.desc("n_chars"), F.col("doc_id")], 25, 40)


@query("first_seen_text", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY sha1(text)")
def first_seen_text(spark, sf_dir):
    """W-06, O-04."""
    return S.first_seen(table(spark, sf_dir, "documents"), F.sha1("text"), "doc_id").select("doc_id")


@query("distinct_sketch", "SELECT event_type, count(DISTINCT user_id) AS users, true AS close FROM events GROUP BY event_type")
def distinct_sketch(spark, sf_dir):
    """A-15: exact distinct users, and whether a sketch of 5 % relative error is within 15 % of them."""
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.approx_count_distinct("user_id", 0.05).alias("about"))
    return e.select("event_type", "users", (F.abs(F.col("about") - F.col("users")) <= F.greatest(F.lit(2), F.col("users") * 0.15)).alias("close"))


LIVE = """WITH h AS (SELECT user_id AS claim, event_id, event_id % 2 = 0 AS review, event_id % 97 / 96.0 AS cosine, CASE event_id % 6 WHEN 0 THEN 'Refuted' WHEN 2 THEN 'Supported' WHEN 4 THEN NULL END AS verdict FROM events),
m AS (SELECT claim, arg_min(event_id, (-cosine, event_id)) AS match FROM h WHERE review AND cosine >= 0.9 AND verdict IS NOT NULL GROUP BY claim),
r AS (SELECT h.*, row_number() OVER (PARTITION BY claim, review ORDER BY cosine DESC, event_id) AS n FROM h)"""


def hits(spark, sf_dir):
    """Events stand in for live hits: even ones are reviews with a rating, odd ones are pages."""
    e = F.col("event_id")
    verdict = F.when(e % 6 == 0, "Refuted").when(e % 6 == 2, "Supported")
    source = F.when(e % 2 == 0, "factcheck").otherwise("wikipedia")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("claim"), F.col("event_id").alias("hit"), source.alias("source"), (e % 97 / 96.0).alias("cosine"), verdict.alias("verdict"))


@query("live_gather", LIVE + " SELECT r.claim, event_id AS hit, CASE WHEN review THEN 'factcheck' ELSE 'wikipedia' END AS source, coalesce(event_id = match, false) AS matched FROM r LEFT JOIN m USING (claim) WHERE (review AND n <= 3) OR (NOT review AND n <= 5) OR event_id = match")
def live_gather(spark, sf_dir):
    """R-13: of each claim the match, the three best reviews and the five best pages."""
    return R.live_gather(hits(spark, sf_dir), "claim", "hit").select("claim", "hit", "source", "matched")


@query("best_live_match", LIVE + " SELECT claim, arg_min(event_id, (-cosine, event_id)) AS hit, max(cosine) AS cosine FROM h WHERE review AND verdict IN ('Supported', 'Refuted') GROUP BY claim")
def best_live_match(spark, sf_dir):
    """R-14."""
    return R.best_sided(hits(spark, sf_dir).filter("source = 'factcheck'"), "claim", "hit").select("claim", "hit", "cosine")


@query(
    "selection_rule",
    PRED + """, t AS (SELECT DISTINCT confidence AS tau FROM p), c AS (SELECT tau, count(*) FILTER (confidence >= tau) AS shown, count(*) FILTER (confidence >= tau AND gold = pred) AS correct, count(*) FILTER (confidence >= tau AND pred = 1 AND gold = 0) AS bad FROM p, t GROUP BY tau)
    SELECT min(tau) AS tau FROM c WHERE correct >= 0.61::DOUBLE * shown AND correct >= ceil(1.3 * 5) AND bad <= 20""",
)
def selection_rule(spark, sf_dir):
    """V-12: the least tau whose precision, wrong supports and correct answers keep to the limits."""
    return E.select_tau(predictions(spark, sf_dir), precision=0.61, false_supported=20, baseline=5)


#: Variant, order, false supports, accuracy, regressions, gained, unverifiable decided.
VARIANTS = [("a", 0, 2, 0.9, 0, 3, 0), ("b", 1, 1, 0.7, 0, 1, 0), ("c", 2, 1, 0.8, 1, 5, 0), ("d", 3, 1, 0.8, 0, 5, 0)]


@query(
    "adopted_variant",
    f"SELECT variant, regressed = 0 AND gained >= 1 AND undecidable = 0 AS adopted FROM {spelled(VARIANTS, 'variant, pos, false_supported, accuracy, regressed, gained, undecidable')} ORDER BY false_supported, accuracy DESC, pos LIMIT 1",
)
def adopted_variant(spark, sf_dir):
    """V-12: fewest false supports, then accuracy, then order; adopted if it loses nothing, gains something and decides nothing open."""
    rows = spark.createDataFrame(VARIANTS, "variant string, at int, false_supported int, accuracy double, regressed int, gained int, undecidable int")
    best = rows.orderBy("false_supported", F.desc("accuracy"), "at").limit(1)
    return best.select("variant", ((F.col("regressed") == 0) & (F.col("gained") >= 1) & (F.col("undecidable") == 0)).alias("adopted"))


@query(
    "calibration_bundle",
    PRED + """, b AS (SELECT least(floor(confidence * 10), 9) AS b, count(*) AS n, avg((gold = pred)::INT) AS a, avg(confidence) AS c FROM p GROUP BY 1), s AS (SELECT * FROM p WHERE confidence >= 0.5)
    SELECT (SELECT round(sum(n * abs(a - c)) / sum(n), 6) FROM b) AS ece, (SELECT round(avg((gold = pred)::INT), 6) FROM p) AS accuracy, (SELECT count(*) FROM s) AS shown, (SELECT round(count(*) / (SELECT count(*) FROM p), 6) FROM s) AS coverage, (SELECT round(avg((gold = pred)::INT), 6) FROM s) AS selective_accuracy""",
)
def calibration_bundle(spark, sf_dir):
    """M-16: calibration error, accuracy, and what is left at a fixed limit, in one row."""
    p = predictions(spark, sf_dir)
    right, shown = F.avg((F.col("gold") == F.col("pred")).cast("int")), F.col("confidence") >= 0.5
    own = p.agg(F.round(right, 6).alias("accuracy"), F.count(F.when(shown, 1)).alias("shown"), F.round(F.avg(shown.cast("int")), 6).alias("coverage"), F.round(F.avg(F.when(shown, (F.col("gold") == F.col("pred")).cast("int"))), 6).alias("selective_accuracy"))
    return own.crossJoin(M.ece(p).select(F.round("ece", 6).alias("ece")))  # one row by one row


@query(
    "cross_cosines",
    """WITH u AS (SELECT label, i, avg(x / norm) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i, sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE))) AS norm FROM embeddings) GROUP BY label, i)
    SELECT a.label AS a, b.label AS b, round(sum(a.m * b.m), 5) AS cosine FROM u a JOIN u b ON a.i = b.i AND a.label < b.label GROUP BY ALL""",
)
def cross_cosines(spark, sf_dir):
    """M-37: the mean cosine between groups. It is the product of the groups' mean unit vectors, so no pair of rows is made."""
    return E.cross_cosines(table(spark, sf_dir, "embeddings"), "label", "embedding").select("a", "b", F.round("cosine", 5).alias("cosine"))


@query("word_faithfulness", "WITH r AS (SELECT user_id, avg(event_id % 97 / 96.0) AS top, avg(event_id % 89 / 200.0) AS rnd, avg(event_id % 83 / 400.0) AS bottom FROM events GROUP BY user_id) SELECT count(*) AS n, round(avg((top > rnd)::INT), 6) AS win_rate, round(avg(top) / avg(rnd), 4) AS ratio, avg(bottom) <= avg(rnd) AS bottom_ok, avg((top > rnd)::INT) >= 0.8 AND avg(top) / avg(rnd) >= 2 AND avg(bottom) <= avg(rnd) AS passes FROM r")
def word_faithfulness(spark, sf_dir):
    """M-26."""
    e = F.col("event_id")
    r = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg(e % 97 / 96.0).alias("top"), F.avg(e % 89 / 200.0).alias("rnd"), F.avg(e % 83 / 400.0).alias("bottom"))
    return E.word_faithfulness(r)


# -- estimators: fitted here, so tests hold their accuracy and the queries have no SQL


@query("language_id")
def language_id(spark, sf_dir):
    """E-01, E-12: languages of documents by character grams; each document is scored by a model that has not seen its fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text", T.fold(F.col("doc_id"), 2).alias("fold"))
    sides = {"text": L.char_terms(F.col("text"))}
    scored = L.cross_fitted(docs, "fold", lambda d: L.fit_terms(d, "doc_id", "lang", sides), lambda d, m: L.score_terms(d, "doc_id", sides, m), 2)
    return scored.select("doc_id", F.col("label").alias("lang"), F.round("p", 4).alias("p"), "fold")


@query("stance_terms")
def stance_terms(spark, sf_dir):
    """E-02: documents' quality from words and pairs of the text and of its source, and from the source alone (the control)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    d = d.select("*", T.fold(F.col("doc_id"), 2).alias("fold"))
    claim = {"claim": L.word_grams(F.col("source"))}
    out = None
    for name, sides in (("both", {**claim, "evidence": L.word_grams(F.col("text"))}), ("control", claim)):
        fit = lambda x, sides=sides: L.fit_terms(x, "doc_id", "quality", sides, most=50_000, training_rows=2000)
        s = L.cross_fitted(d, "fold", fit, lambda x, m, sides=sides: L.score_terms(x, "doc_id", sides, m), 2).withColumn("arm", F.lit(name))
        out = s if out is None else out.unionByName(s)
    return out.select("arm", "doc_id", F.col("label").alias("quality"), F.round("p", 4).alias("p"))


@query("learned_verdict")
def learned_verdict(spark, sf_dir):
    """E-11, V-02, M-40: claims' verdicts by a fitted model on 19 features, with its temperature."""
    from veristrata.operators.evaluation import stance_features

    e = F.col("event_id")
    p = table(spark, sf_dir, "events").select(F.col("user_id").alias("claim"), "event_id", (e % 97 / 200.0).alias("support"), (e % 89 / 190.0).alias("refute"), (e % 11 / 10.0).alias("dense"))
    p = p.withColumns({"neutral": 1 - F.col("support") - F.col("refute"), "rank": F.row_number().over(Window.partitionBy("claim").orderBy(F.desc("dense"), "event_id"))})
    x = stance_features(p, "claim")
    names = [c for c in x.columns if c != "claim"]
    label = F.when(F.col("ranked") > 0.04, "Supported").when(F.col("ranked") < -0.04, "Refuted").otherwise("NEI")
    x = x.select("*", label.alias("label"), T.fold(F.col("claim"), 2).alias("fold")).cache()
    model = L.fit_verdict(x.filter("fold = 0"), names)
    dev = x.filter("fold = 1").select(L.verdict_logits(model).alias("logits"), (F.array_position(F.array(*map(F.lit, L.VERDICTS)), F.col("label")) - 1).alias("at"))
    model["temperature"] = L.fit_temperature(dev)
    found = L.learned_verdict(x, model, "claim", F.lit(1))
    return found.select("claim", "verdict", F.round("confidence", 4).alias("confidence")).join(x.select("claim", "label", "fold"), "claim")


@query("word_vectors")
def word_vectors(spark, sf_dir):
    """E-04."""
    return L.word_vectors(table(spark, sf_dir, "documents"), "doc_id", "text", 16)
