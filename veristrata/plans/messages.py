"""Queries of ratings, pressure techniques, hoax cues, sentences and claims."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from veristrata.functions import messages as M
from veristrata.functions import ratings as R
from veristrata.functions import text as T
from veristrata.operators.retrieval import best_lines
from veristrata.registry import query, spelled, spread, table

#: Cell, labels, verdict: worked out by hand.
RATINGS = [
    ("['False']", ["false"], "Refuted"),
    ("['False', 'fake ']", ["false", "fake"], "Refuted"),
    ("['True', 'Misleading']", ["true", "misleading"], None),
    (" Half true ", ["half true"], "Conflicting"),
    ("('Yanlış',)", ["yanlış"], "Refuted"),
    ("['Pinocchio', 'true']", ["pinocchio", "true"], "Supported"),
    ("[unquoted", ["[unquoted"], None),
    ("'Unproven'", ["unproven"], "NEI"),
    ("", [], None),
    (None, [], None),
    ("[]", [], None),
    ("7", [], None),
    ("mostly false-ish", ["mostly false-ish"], None),
    ("[' ', 'FAUX']", ["faux"], "Refuted"),
]


@query(
    "rating_verdict",
    f"""SELECT id::BIGINT AS id, array_to_string(labels::VARCHAR[], '|') AS labels, verdict, CASE WHEN verdict = 'Supported' THEN 0.9 ELSE 0.0 END AS support,
    CASE WHEN verdict = 'Refuted' THEN 0.9 ELSE 0.0 END AS refute, CASE WHEN verdict IN ('Supported', 'Refuted') THEN 0.1 ELSE 1.0 END AS neutral
    FROM {spelled([(i, labels, v) for i, (_, labels, v) in enumerate(RATINGS)], 'id, labels, verdict')}""",
)
def rating_verdict(spark, sf_dir):
    """N-31, N-32, V-06."""
    cells = spark.createDataFrame([(i, c) for i, (c, _, _) in enumerate(RATINGS)], "id bigint, cell string")
    labelled = cells.select("id", R.ratings(F.col("cell")).alias("l"))
    sure = labelled.select("id", F.array_join("l", "|").alias("labels"), R.verdict(F.col("l")).alias("verdict"), R.stance(F.col("l")).alias("s"))
    return sure.select("id", "labels", "verdict", "s.support", "s.refute", F.round("s.neutral", 6).alias("neutral"))


COVERAGE = " UNION ALL ".join(f"SELECT unnest({list(words)!r}) AS rating, '{v}' AS verdict" for v, words in R.VERDICTS.items())


@query(
    "verdict_coverage",
    f"""WITH m AS ({COVERAGE}), r AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'false' WHEN 1 THEN 'true' WHEN 2 THEN 'half true' WHEN 3 THEN 'four pinocchios' WHEN 4 THEN 'unproven' WHEN 5 THEN event_type ELSE 'fake' END AS rating FROM events)
    SELECT coalesce(verdict, 'unmapped') AS verdict, count(*) AS n, count(DISTINCT rating) AS ratings, round(count(*) / (SELECT count(*) FROM r), 6) AS share FROM r LEFT JOIN m USING (rating) GROUP BY 1""",
)
def verdict_coverage(spark, sf_dir):
    """M-35: how many ratings the map reaches."""
    e = F.col("event_id") % 7
    rating = F.when(e == 0, "false").when(e == 1, "true").when(e == 2, "half true").when(e == 3, "four pinocchios").when(e == 4, "unproven").when(e == 5, F.col("event_type")).otherwise("fake")
    r = table(spark, sf_dir, "events").select(rating.alias("rating")).groupBy("rating").agg(F.count("*").alias("n"))
    r = r.withColumn("verdict", F.coalesce(R.verdict(F.array("rating")), F.lit("unmapped")))
    total = r.agg(F.sum("n").alias("total"))
    by = r.groupBy("verdict").agg(F.sum("n").alias("n"), F.count("*").alias("ratings"))
    return by.crossJoin(F.broadcast(total)).select("verdict", "n", "ratings", F.round(F.col("n") / F.col("total"), 6).alias("share"))


URLS = [
    ("https://web.archive.org/web/2020*/https://A.org/x/", "a.org/x"),
    ("HTTP://www.B.com//", "www.b.com"),
    ("c.net/q?z=1", "c.net/q?z=1"),
    ("", ""),
    (None, None),
]


@query("canonical_urls", f"SELECT page_id, lower(regexp_replace(regexp_replace(url, '^https?://', '', 'i'), '/+$', '')) AS url FROM pages UNION ALL SELECT id::BIGINT, url FROM {spelled([(-i - 1, u) for i, (_, u) in enumerate(URLS)], 'id, url')}")
def canonical_urls(spark, sf_dir):
    """N-28 on the pages and on cases that they lack."""
    cases = spark.createDataFrame([(-i - 1, u) for i, (u, _) in enumerate(URLS)], "page_id bigint, url string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url").unionByName(cases)
    return pages.select("page_id", R.canonical_url(F.col("url")).alias("url"))


IDS = [("store:train.json:12", "train", 12), ("x_1:dev.json:0", "dev", 0), ("X:train.json:1", None, None), ("a:test.json:3", None, None), ("a:train.json:", None, None), (None, None, None)]


@query("id_parse", f"SELECT id::BIGINT AS id, split, n::BIGINT AS n FROM {spelled([(i, s, n) for i, (_, s, n) in enumerate(IDS)], 'id, split, n')}")
def id_parse(spark, sf_dir):
    """N-34."""
    ids = spark.createDataFrame([(i, u) for i, (u, _, _) in enumerate(IDS)], "id bigint, uid string")
    return ids.select("id", R.source_index(F.col("uid")).alias("s")).select("id", "s.split", F.col("s.at").alias("n"))


#: Message, techniques, hoax cues: worked out by hand.
MESSAGES = [
    ("URGENT!! Doctors say this cures cancer. SHARE THIS now", ["Appeal_to_Time", "Loaded_Language", "Appeal_to_Authority"], ["miracle_cure"]),
    ("who said it", [], []),
    ("WHO said it", ["Appeal_to_Authority"], []),
    ("alertness is not an alert-word", ["Loaded_Language"], []),
    ("a b c a b c a b c", ["Repetition"], []),
    ("सावधान! कल से charge", ["Loaded_Language"], ["threat_or_charge"]),
    ("big pharma is hiding this: free laptop", [], ["concealment", "giveaway"]),
    ("freedom of data", [], []),
    ("NASA WARN EVERYONE", ["Loaded_Language", "Appeal_to_Authority"], []),
    ("everyone knows 🚨 turant", ["Appeal_to_Time", "Loaded_Language", "Appeal_to_Popularity"], []),
    ("   ", [], []),
    (None, [], []),
]


@query("technique_cases", f"SELECT id::BIGINT AS id, array_to_string(t::VARCHAR[], '|') AS techniques, array_to_string(c::VARCHAR[], '|') AS cues FROM {spelled([(i, t, c) for i, (_, t, c) in enumerate(MESSAGES)], 'id, t, c')}")
def technique_cases(spark, sf_dir):
    """N-48 and N-49 on messages that the tables lack."""
    said = spark.createDataFrame([(i, m) for i, (m, _, _) in enumerate(MESSAGES)], "id bigint, m string")
    return said.select("id", F.array_join(M.techniques(F.col("m")), "|").alias("techniques"), F.array_join(M.hoax_cues(F.col("m")), "|").alias("cues"))


def sql_any(column: str, words) -> str:
    plain = "|".join(re.escape(w).replace("'", "''") for w in words if w.isascii())
    other = "|".join(w for w in words if not w.isascii())
    tests = [f"regexp_matches({column}, '(^|[^a-z])({plain})([^a-z]|$)')" if plain else "", f"regexp_matches({column}, '{other}')" if other else ""]
    return "(" + " OR ".join(t for t in tests if t) + ")"


TRIGRAMS = r"""t AS (SELECT key, max(n) AS most FROM (SELECT key, g, count(*) AS n FROM (SELECT key, unnest(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) AS g
  FROM (SELECT key, regexp_extract_all(low, '[\p{L}\p{N}_]+') AS w FROM m) WHERE len(w) >= 3) GROUP BY ALL) GROUP BY key)"""
FLAGGED = {name: sql_any("low", words) for name, words in M.TECHNIQUES.items()}
FLAGGED["Appeal_to_Authority"] += " OR regexp_matches(text, 'WHO|ICMR')"
FLAGGED["Loaded_Language"] += r" OR regexp_matches(text, '!!') OR len(regexp_extract_all(text, '\b[A-Z]{4,}\b')) >= 2"
FLAGGED["Repetition"] = "coalesce(most, 0) >= 3"
NAMES = "list_filter([" + ", ".join(f"CASE WHEN {FLAGGED[n]} THEN '{n}' END" for n in M.ORDER if n in FLAGGED) + "], lambda x: x IS NOT NULL)[1:3]"


@query("manipulation_flags", f"WITH m AS (SELECT doc_id AS key, text, lower(text) AS low FROM documents), {TRIGRAMS} SELECT key AS doc_id, array_to_string({NAMES}, '|') AS flags FROM m LEFT JOIN t USING (key)")
def manipulation_flags(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(M.techniques(F.col("text")), "|").alias("flags"))


CUES = [
    ("concealment", sql_any("low", M.CONCEAL)),
    ("giveaway", f"{sql_any('low', M.FREE)} AND {sql_any('low', M.GIVEAWAY)}"),
    ("miracle_cure", f"{sql_any('low', M.CURE)} AND {sql_any('low', M.HEALTH)}"),
    ("threat_or_charge", f"{sql_any('low', M.THREAT)} OR {sql_any('low', M.DEADLINE)} AND {sql_any('low', M.CHARGE)}"),
]


@query("hoax_cues", f"SELECT cue, count(*) AS n FROM (SELECT unnest([{', '.join(f'CASE WHEN {c} THEN {chr(39)}{n}{chr(39)} END' for n, c in CUES)}, 'any']) AS cue FROM (SELECT lower(text) AS low FROM conversations)) WHERE cue IS NOT NULL GROUP BY cue")
def hoax_cues(spark, sf_dir):
    found = F.explode(F.concat(M.hoax_cues(F.col("text")), F.array(F.lit("any")))).alias("cue")
    return table(spark, sf_dir, "conversations").select(found).groupBy("cue").agg(F.count("*").alias("n"))


@query(
    "negative_claims",
    r"""WITH w AS (SELECT conv_id, turn, role, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM conversations)
    SELECT conv_id, turn, 2 * turn + part AS at, n FROM (SELECT conv_id, turn, unnest([0, 1]) AS part, unnest([least(len(w), 5), greatest(len(w) - 5, 0)]) AS n FROM w) WHERE part = 0 AND n > 0 OR part = 1 AND n >= 3""",
)
def negative_claims(spark, sf_dir):
    """L-08, F-04: a span of a message (its first five words) is positive; what is left is negative if it has three words."""
    w = F.size(T.tokens(F.col("text")))
    parts = F.posexplode(F.array(F.least(w, F.lit(5)), F.greatest(w - 5, F.lit(0)))).alias("part", "n")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", parts).filter("part = 0 AND n > 0 OR part = 1 AND n >= 3")
    return rows.select("conv_id", "turn", (2 * F.col("turn") + F.col("part")).alias("at"), F.col("n").cast("bigint").alias("n"))


@query(
    "best_sentence",
    r"""WITH q AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS terms FROM benchmark),
    s AS (SELECT doc_id, pos, sentence, regexp_extract_all(lower(sentence), '[\p{L}\p{N}_]+') AS ws FROM (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) AS pos FROM (SELECT doc_id, regexp_split_to_array(text, '\n') AS s FROM documents))),
    d AS (SELECT DISTINCT doc_id, pos, len(ws) AS n, unnest(ws) AS term FROM s), t AS (SELECT item_id, unnest(terms) AS term FROM q),
    c AS (SELECT item_id, doc_id, pos, count(*) / sqrt(n) AS score FROM t JOIN d USING (term) GROUP BY item_id, doc_id, pos, n)
    SELECT item_id, doc_id, pos, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id, pos) AS r FROM c) WHERE r = 1""",
)
def best_sentence(spark, sf_dir):
    """N-43, N-44: the paragraph of all documents that an item's distinct terms fit best, the earliest of equals."""
    lines = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    words = lines.select("doc_id", (F.col("pos") + 1).cast("bigint").alias("pos"), T.tokens(F.col("line")).alias("w"))
    return best_lines(words, table(spark, sf_dir, "benchmark").select("item_id", T.tokens(F.col("text")).alias("w")), "item_id", "doc_id")
