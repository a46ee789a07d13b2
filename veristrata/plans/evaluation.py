"""Queries of bundles, curves, spans, edit rates, gates, resampled intervals and features."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from veristrata.operators import evaluation as E
from veristrata.operators import metrics as M
from veristrata.plans.metrics import PRED, labels, predictions
from veristrata.plans.retrieval import DENSE_SQL, dense_best
from veristrata.registry import query, spelled, table


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(
    "classification_bundle",
    PRED + """, c AS (SELECT lang, * EXCLUDE (lang) FROM p UNION ALL SELECT 'overall', * EXCLUDE (lang) FROM p),
    k AS (SELECT DISTINCT lang, label FROM c, (VALUES (0), (1)) t(label)),
    s AS (SELECT k.lang, label, count(*) FILTER (gold = label AND pred = label) AS tp, count(*) FILTER (pred = label) AS np, count(*) FILTER (gold = label) AS ng FROM k JOIN c USING (lang) GROUP BY k.lang, label),
    f AS (SELECT lang, avg(CASE WHEN np + ng = 0 THEN 0 ELSE 2 * tp / (np + ng) END) AS macro_f1 FROM s GROUP BY lang)
    SELECT lang AS cell, count(*) AS n, count(*) < 30 AS low_n, round(avg((gold = pred)::INT), 6) AS accuracy, round(any_value(macro_f1), 6) AS macro_f1 FROM c JOIN f USING (lang) GROUP BY lang""",
)
def classification_bundle(spark, sf_dir):
    """M-07, M-08, M-11, A-02: accuracy, macro-F1 and n over all rows and in each language, in one pass over the counts."""
    p = predictions(spark, sf_dir)
    cells = p.groupBy("lang", "gold", "pred").agg(F.count("*").alias("n"))
    every = cells.select(F.explode(F.array("lang", F.lit("overall"))).alias("cell"), "gold", "pred", "n").groupBy("cell", "gold", "pred").agg(F.sum("n").alias("n"))
    sides = every.select("cell", "n", F.explode(F.array(*(F.struct(F.lit(x).alias("label"), (F.col("gold") == x).cast("int").alias("g"), (F.col("pred") == x).cast("int").alias("p")) for x in (0, 1)))).alias("s"))
    s = sides.groupBy("cell", "s.label").agg(F.sum(F.col("n") * F.col("s.g") * F.col("s.p")).alias("tp"), F.sum(F.col("n") * F.col("s.p")).alias("np"), F.sum(F.col("n") * F.col("s.g")).alias("ng"))
    f = s.groupBy("cell").agg(F.sum("ng").alias("n"), (F.sum("tp") / F.sum("ng")).alias("accuracy"), F.avg(M.ratio(2 * F.col("tp"), F.col("np") + F.col("ng"))).alias("macro_f1"))
    return rounded(f.select("cell", "n", (F.col("n") < 30).alias("low_n"), "accuracy", "macro_f1"), "accuracy", "macro_f1")


@query(
    "selective_macro_f1",
    PRED + """, t AS (SELECT unnest([0.3, 0.5, 0.7, 0.9])::DOUBLE AS tau), c AS (SELECT tau, gold, pred FROM p, t WHERE confidence >= tau),
    s AS (SELECT tau, label, count(*) FILTER (gold = label AND pred = label) AS tp, count(*) FILTER (pred = label) + count(*) FILTER (gold = label) AS d FROM c, (VALUES (0), (1)) k(label) GROUP BY tau, label)
    SELECT tau, round(avg(CASE WHEN d = 0 THEN 0 ELSE 2 * tp / d END), 6) AS macro_f1 FROM s GROUP BY tau""",
)
def selective_macro_f1(spark, sf_dir):
    """M-15."""
    taus = F.explode(F.array(*map(F.lit, (0.3, 0.5, 0.7, 0.9)))).alias("tau")
    c = predictions(spark, sf_dir).select("gold", "pred", "confidence", taus).filter("confidence >= tau")
    return rounded(M.macro_f1(c, labels(spark), ["tau"]), "macro_f1")


TOP = DENSE_SQL + """, top AS (SELECT query_id, q_label, round(score, 6) AS top, CASE WHEN q_label = 0 THEN NULL ELSE label = q_label END AS correct FROM dr WHERE rank = 1),
w AS (SELECT query_id, max(round(score, 6)) AS wrong FROM c WHERE label <> q_label GROUP BY query_id), f AS (SELECT top, correct, wrong FROM top LEFT JOIN w USING (query_id)), t AS (SELECT unnest([0.1, 0.2, 0.3, 0.4])::DOUBLE AS tau)"""


def fast_path(spark, sf_dir):
    """Per query: the best score, whether it is right (null: label 0 stands for queries without gold), and the best wrong score."""
    top = dense_best(spark, sf_dir, 1).select("query_id", "q_label", "label", F.col("score").alias("top"))
    wrong = dense_best(spark, sf_dir, 1, others=True).select("query_id", F.col("score").alias("wrong"))
    best = top.join(wrong, "query_id", "left")
    return best.select("top", F.when(F.col("q_label") != 0, F.col("label") == F.col("q_label")).alias("correct"), "wrong")


@query(
    "fast_path_curve",
    TOP + """, g AS (SELECT tau, count(correct) AS n, count(*) FILTER (correct IS NOT NULL AND top >= tau) AS accepted, count(*) FILTER (correct AND top >= tau) AS good, count(wrong) AS negatives,
    count(*) FILTER (wrong >= tau) AS bad, count(*) FILTER (correct IS NULL) AS "natural" FROM f, t GROUP BY tau)
    SELECT tau, n, accepted, negatives, "natural", round(CASE WHEN n = 0 THEN 0 ELSE accepted / n END, 6) AS coverage, round(CASE WHEN accepted = 0 THEN 0 ELSE good / accepted END, 6) AS precision,
    round(CASE WHEN n = 0 THEN 0 ELSE good / n END, 6) AS yield, round(CASE WHEN negatives = 0 THEN 0 ELSE bad / negatives END, 6) AS false_accept_rate FROM g""",
)
def fast_path_curve(spark, sf_dir):
    """M-19, M-20."""
    return rounded(E.fast_path_curve(fast_path(spark, sf_dir), [0.1, 0.2, 0.3, 0.4]), "coverage", "precision", "yield", "false_accept_rate")


#: Reference, hypothesis and edits over words, worked out by hand.
EDITS = [("the cat sat", "the cat sat", 0), ("the cat sat", "cat sat down", 2), ("a b c", "", 3), ("", "x y", 2), ("a b a b", "b a b a", 2), ("one", "two", 1), ("k i t t e n", "s i t t i n g", 3)]


@query("edit_rates", f"SELECT id::BIGINT AS id, words::BIGINT AS words, levenshtein(ref, hyp) AS chars, ref = hyp AS exact FROM {spelled([(i, *r) for i, r in enumerate(EDITS)], 'id, ref, hyp, words')}")
def edit_rates(spark, sf_dir):
    """N-52, M-21: edits over words and characters on cases."""
    split = lambda c: F.filter(F.split(c, " "), lambda x: x != "")
    rows = spark.createDataFrame([(i, r[0], r[1]) for i, r in enumerate(EDITS)], "id bigint, ref string, hyp string").withColumns({"a": split("ref"), "b": split("hyp")})
    return rows.select("id", E.word_edits(F.col("a"), F.col("b")).cast("bigint").alias("words"), F.levenshtein("ref", "hyp").cast("bigint").alias("chars"), (F.col("ref") == F.col("hyp")).alias("exact"))


@query(
    "chrf",
    r"""WITH x AS (SELECT item_id, regexp_replace(replace(text, 'a', 'e'), '\s+', '', 'g') AS hyp, regexp_replace(text, '\s+', '', 'g') AS ref FROM benchmark), n AS (SELECT unnest(generate_series(1, 6)) AS n),
    g AS (SELECT item_id, n, unnest(list_transform(generate_series(1, length(hyp) - n + 1), lambda i: substr(hyp, i, n))) AS g, 1 AS h, 0 AS r FROM x, n WHERE length(hyp) >= n
      UNION ALL SELECT item_id, n, unnest(list_transform(generate_series(1, length(ref) - n + 1), lambda i: substr(ref, i, n))), 0, 1 FROM x, n WHERE length(ref) >= n),
    c AS (SELECT item_id, n, g, sum(h) AS h, sum(r) AS r FROM g GROUP BY ALL), o AS (SELECT item_id, n, sum(least(h, r)) AS common, sum(h) AS h, sum(r) AS r FROM c GROUP BY ALL),
    m AS (SELECT item_id, avg(common / nullif(h, 0)) AS p, avg(common / nullif(r, 0)) AS q FROM o GROUP BY item_id)
    SELECT item_id, round(coalesce(CASE WHEN 4 * p + q = 0 THEN 0 ELSE 5 * p * q / (4 * p + q) END, 0), 6) AS chrf FROM x LEFT JOIN m USING (item_id)""",
)
def chrf(spark, sf_dir):
    """N-53, M-23, O-05: items against themselves with every a as e."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.replace("text", F.lit("a"), F.lit("e")).alias("hyp"), F.col("text").alias("ref"))
    return rounded(E.chrf(rows, "item_id"), "chrf")


TAGS = "WITH t AS (SELECT user_id, event_id % 3 <> 0 AS gold, event_id % 5 < 3 OR user_id % 10 = 0 AND event_id % 3 <> 0 AS pred FROM events)"
SPANS = """, s AS (SELECT user_id, sum((gold AND pred)::INT) AS tp, sum(pred::INT) AS p, sum(gold::INT) AS g, min((gold = pred)::INT) AS exact FROM t GROUP BY user_id),
a AS (SELECT sum(tp) / sum(p) AS token_precision, sum(tp) / sum(g) AS token_recall, avg(exact) AS exact_span_match, count(*) AS n FROM s)
SELECT round(token_precision, 6) AS token_precision, round(token_recall, 6) AS token_recall, round(2 * token_precision * token_recall / (token_precision + token_recall), 6) AS token_f1, round(exact_span_match, 6) AS exact_span_match, n FROM a"""


def tags(spark, sf_dir):
    e, u = F.col("event_id"), F.col("user_id")
    return table(spark, sf_dir, "events").select("user_id", (e % 3 != 0).alias("gold"), ((e % 5 < 3) | (u % 10 == 0) & (e % 3 != 0)).alias("pred"))


@query("span_f1", TAGS + SPANS)
def span_f1(spark, sf_dir):
    """M-22: a user's events stand in for the tokens of a post."""
    return rounded(E.span_scores(tags(spark, sf_dir), "user_id"), "token_precision", "token_recall", "token_f1", "exact_span_match")


@query("whole_post_span", TAGS.replace("event_id % 5 < 3 OR user_id % 10 = 0 AND event_id % 3 <> 0 AS pred", "true AS pred") + SPANS)
def whole_post_span(spark, sf_dir):
    """BL-5: every token is a claim token."""
    return rounded(E.span_scores(tags(spark, sf_dir).withColumn("pred", F.lit(True)), "user_id"), "token_precision", "token_recall", "token_f1", "exact_span_match")


@query("post_span_f1", TAGS + ", s AS (SELECT user_id, 2 * sum((gold AND pred)::INT) / (sum(pred::INT) + sum(gold::INT)) AS f1 FROM t GROUP BY user_id) SELECT user_id, round(f1, 6) AS f1 FROM s WHERE f1 < 0.5")
def post_span_f1(spark, sf_dir):
    """M-39: posts whose own F1 is under a half."""
    g, p = F.col("gold").cast("int"), F.col("pred").cast("int")
    f1 = tags(spark, sf_dir).groupBy("user_id").agg(M.ratio(2 * F.sum(g * p), F.sum(g) + F.sum(p)).alias("f1"))
    return rounded(f1.filter("f1 < 0.5"), "f1")


CLAIMS = PRED + """, r AS (SELECT id, CASE WHEN gold = 1 THEN 'T' WHEN id % 4 = 0 THEN 'U' ELSE 'F' END AS gold, CASE WHEN confidence < 0.4 THEN NULL WHEN pred = 1 THEN 'Supported' ELSE 'Refuted' END AS shown,
CASE WHEN confidence < 0.4 THEN NULL WHEN id % 3 = 0 THEN 'factcheck' ELSE 'wikipedia' END AS decider FROM p)"""


def claims(spark, sf_dir):
    p, i, c = predictions(spark, sf_dir), F.col("id"), F.col("confidence")
    gold = F.when(F.col("gold") == 1, "T").when(i % 4 == 0, "U").otherwise("F").alias("gold")
    return p.select("id", gold, F.when(c >= 0.4, F.when(F.col("pred") == 1, "Supported").otherwise("Refuted")).alias("shown"), F.when(c >= 0.4, F.when(i % 3 == 0, "factcheck").otherwise("wikipedia")).alias("decider"))


WILSON = "({k} / {n} + 1.959964 ** 2 / (2 * {n}) {s} 1.959964 * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + 1.959964 ** 2 / (4 * {n} * {n}))) / (1 + 1.959964 ** 2 / {n})"


@query(
    "real_claims",
    CLAIMS + f""", x AS (SELECT coalesce(decider, 'none') AS decider, gold, shown FROM r UNION ALL SELECT 'all', gold, shown FROM r),
    s AS (SELECT decider, count(*) AS n, count(shown) AS shown, count(*) FILTER (shown IS NOT NULL AND gold <> 'U') AS decidable, count(*) FILTER (gold <> 'U' AND (shown = 'Supported') = (gold = 'T')) AS correct,
    count(*) FILTER (gold = 'F') AS gold_false, count(*) FILTER (gold = 'F' AND shown = 'Supported') AS false_supported, count(*) FILTER (gold = 'U' AND shown IS NOT NULL) AS on_unverifiable FROM x GROUP BY decider),
    w AS (SELECT *, CASE WHEN decidable > 0 THEN correct / decidable END AS precision, CASE WHEN decidable > 0 THEN greatest(0, {WILSON.format(k='correct', n='nullif(decidable, 0)', s='-')}) ELSE 0 END AS precision_lo,
    CASE WHEN gold_false > 0 THEN least(1, {WILSON.format(k='false_supported', n='nullif(gold_false, 0)', s='+')}) ELSE 1 END AS false_supported_hi FROM s)
    SELECT decider, n, shown, decidable, correct, gold_false, false_supported, on_unverifiable, round(precision, 6) AS precision, round(precision_lo, 6) AS precision_lo, round(false_supported_hi, 6) AS false_supported_hi,
    CASE WHEN coalesce(precision >= 0.85 AND precision_lo >= 0.8, false) AND false_supported_hi <= 0.08 THEN 'transfers' WHEN coalesce(precision >= 0.85 AND precision_lo >= 0.8, false) OR false_supported_hi <= 0.08 THEN 'partly transfers' ELSE 'does not transfer' END AS transfers FROM w""",
)
def real_claims(spark, sf_dir):
    """M-28, M-31, A-12."""
    return rounded(E.real_claims(claims(spark, sf_dir)), "precision", "precision_lo", "false_supported_hi")


@query(
    "cluster_consistency",
    CLAIMS + """, c AS (SELECT id // 10 AS cluster, count(*) AS n, count(shown) AS got, count(DISTINCT shown) AS kinds FROM r GROUP BY 1)
    SELECT CASE WHEN got = 0 THEN 'all_silent' WHEN got < n THEN 'mixed_silent_and_shown' WHEN kinds = 1 THEN 'all_shown_agree' ELSE 'shown_but_disagree' END AS kind, count(*) AS clusters FROM c GROUP BY 1""",
)
def cluster_consistency(spark, sf_dir):
    """M-29."""
    c = claims(spark, sf_dir).groupBy(F.floor(F.col("id") / 10).alias("cluster")).agg(F.count("*").alias("n"), F.count("shown").alias("got"), F.count_distinct("shown").alias("kinds"))
    kind = F.when(F.col("got") == 0, "all_silent").when(F.col("got") < F.col("n"), "mixed_silent_and_shown").when(F.col("kinds") == 1, "all_shown_agree").otherwise("shown_but_disagree")
    return c.groupBy(kind.alias("kind")).agg(F.count("*").alias("clusters"))


POISSON, total = "8", 0.0
for k, limit in reversed([(k, math.fsum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(8)]):
    POISSON = f"CASE WHEN u < {limit!r}::DOUBLE THEN {k} ELSE {POISSON} END"


def resampled(unit: str) -> str:
    return PRED + f""", x AS (SELECT {unit} AS unit, sum((gold = pred)::INT - (gold = 1)::INT) AS v, count(*) AS n FROM p GROUP BY 1), b AS (SELECT *, unnest(generate_series(1, 200)) AS b FROM x),
    y AS (SELECT *, ('0x' || substr(md5(b || ':' || unit), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u FROM b), w AS (SELECT *, {POISSON} AS w FROM y), m AS (SELECT b, sum(w * v) / sum(w * n) AS m FROM w GROUP BY b)
    SELECT round((SELECT sum(v) / sum(n) FROM x), 6) AS mean, round(quantile_disc(m, 0.025), 6) AS lo, round(quantile_disc(m, 0.975), 6) AS hi FROM m"""


@query("bootstrap_ci", resampled("id"))
def bootstrap_ci(spark, sf_dir):
    """M-25: paired difference of right answers between the predictions and always answering 1."""
    gain = (F.col("gold") == F.col("pred")).cast("int") - (F.col("gold") == 1).cast("int")
    return rounded(E.bootstrap(predictions(spark, sf_dir), "id", gain), "mean", "lo", "hi")


@query("cluster_bootstrap_ci", resampled("id // 10"))
def cluster_bootstrap_ci(spark, sf_dir):
    """M-30: as bootstrap_ci, drawing whole clusters."""
    gain = (F.col("gold") == F.col("pred")).cast("int") - (F.col("gold") == 1).cast("int")
    return rounded(E.bootstrap(predictions(spark, sf_dir).withColumn("cluster", F.floor(F.col("id") / 10)), "cluster", gain), "mean", "lo", "hi")


@query(
    "script_gap",
    PRED + """, c AS (SELECT lang, id % 2 = 0 AS native, avg((gold = pred)::INT) AS acc FROM p GROUP BY ALL)
    SELECT lang, round(max(acc) FILTER (native), 6) AS native, round(max(acc) FILTER (NOT native), 6) AS romanised, CASE WHEN lang <> 'en' THEN round(max(acc) FILTER (native) - max(acc) FILTER (NOT native), 6) END AS gap FROM c GROUP BY lang""",
)
def script_gap(spark, sf_dir):
    """M-32: accuracy on native less that on romanised rows (even and odd ids here); English has native rows only."""
    right, native = (F.col("gold") == F.col("pred")).cast("int"), F.col("id") % 2 == 0
    g = predictions(spark, sf_dir).groupBy("lang").agg(F.avg(F.when(native, right)).alias("native"), F.avg(F.when(~native, right)).alias("romanised"))
    return rounded(g.withColumn("gap", F.when(F.col("lang") != "en", F.col("native") - F.col("romanised"))), "native", "romanised", "gap")


@query(
    "careful_rule",
    PRED + """, a AS (SELECT sum((gold = 1)::INT) AS true_n, sum((gold = 1 AND confidence < 0.1)::INT) AS k_t, sum((gold = 1 AND confidence < 0.3)::INT) AS k_b, sum((gold = 0)::INT) AS false_n, sum((gold = 0 AND confidence < 0.2)::INT) AS k_f FROM p)
    SELECT round(k_t / true_n, 6) AS true_rate, round(k_b / true_n, 6) AS baseline_rate, round(k_f / false_n, 6) AS false_rate, k_t / true_n <= 0.15 AND k_t / true_n <= 0.5 * k_b / true_n AND k_f / false_n >= 0.15 AS passes FROM a""",
)
def careful_rule(spark, sf_dir):
    """M-27: gates of a warning rule (confidence under 0.1 on true rows, 0.2 on false ones) against a baseline (0.3)."""
    yes, c = F.col("gold") == 1, F.col("confidence")
    rate = lambda on, when: F.avg(F.when(on, when.cast("int")))
    r = predictions(spark, sf_dir).agg(rate(yes, c < 0.1).alias("true_rate"), rate(yes, c < 0.3).alias("baseline_rate"), rate(~yes, c < 0.2).alias("false_rate"))
    passes = (F.col("true_rate") <= 0.15) & (F.col("true_rate") <= 0.5 * F.col("baseline_rate")) & (F.col("false_rate") >= 0.15)
    return rounded(r.withColumn("passes", passes), "true_rate", "baseline_rate", "false_rate")


RANKED = "WITH p AS (SELECT user_id AS claim, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank, event_id % 97 / 200.0 AS s, event_id % 89 / 190.0 AS r, CASE WHEN event_id % 4 > 0 THEN event_id % 53 / 60.0 END AS d FROM events), k AS (SELECT *, 1 - s - r AS u, 1 / log2(rank + 1) AS w FROM p WHERE rank <= 10)"


@query(
    "stance_features",
    RANKED + """ SELECT claim, round(avg(s), 6) AS mean_s, round(avg(r), 6) AS mean_r, round(avg(u), 6) AS mean_n, round(max(s), 6) AS max_s, round(max(r), 6) AS max_r, round(max(u), 6) AS max_n, round(min(s), 6) AS min_s, round(min(r), 6) AS min_r,
    round(avg((s >= 0.5)::INT), 6) AS share_s, round(avg((r >= 0.5)::INT), 6) AS share_r, round(sum(w * (s - r)) / sum(w), 6) AS ranked, round(max(s) FILTER (rank = 1), 6) AS top_s, round(max(r) FILTER (rank = 1), 6) AS top_r,
    round(max(u) FILTER (rank = 1), 6) AS top_n, round(max(s) * max(r), 6) AS product, round(coalesce(max(d), 0), 6) AS dense_max, round(coalesce(avg(d), 0), 6) AS dense_mean, (count(d) > 0)::INT::DOUBLE AS has_dense, round(count(*) / 10, 6) AS filled FROM k GROUP BY claim""",
)
def stance_features(spark, sf_dir):
    """A-10: a user's events in order of time stand in for a claim's ranked passages."""
    e = F.col("event_id")
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    p = table(spark, sf_dir, "events").select(F.col("user_id").alias("claim"), rank.alias("rank"), (e % 97 / 200.0).alias("support"), (e % 89 / 190.0).alias("refute"), F.when(e % 4 > 0, e % 53 / 60.0).alias("dense"))
    f = E.stance_features(p.withColumn("neutral", 1 - F.col("support") - F.col("refute")), "claim")
    return rounded(f, *(c for c in f.columns if c != "claim"))
