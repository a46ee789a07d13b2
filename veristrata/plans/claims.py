"""Queries of claims, titles, transliteration, language decisions and explanations. Cases hold what the tables lack; they are worked out by hand."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from veristrata.functions import answers as A
from veristrata.functions import claims as C
from veristrata.functions import indic as I
from veristrata.functions import titles as T
from veristrata.registry import query, spelled, table

LIST = "', '".join(C.STOPWORDS)


@query(
    "content_terms",
    rf"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[\p{{P}}\p{{S}}]', '', 'g'), '[ \t\n\r]+'), lambda x: x <> '') AS w FROM documents),
    t AS (SELECT doc_id, list_sort(list_distinct(list_filter(w, lambda x: x NOT IN ('{LIST}') AND NOT regexp_matches(x, '^\p{{Nd}}+$') AND (regexp_matches(x, '[^\x00-\x7F]') OR length(x) >= 3)))) AS t FROM w)
    SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS terms FROM t""",
)
def content_terms(spark, sf_dir):
    """N-15, N-16."""
    t = C.content_terms(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("t")).select("doc_id", F.size("t").cast("bigint").alias("n"), F.md5(F.array_join("t", " ")).alias("terms"))


#: Message, check-worthy, why not.
WORTHY = [
    ("Good morning", False, "greeting"),
    ("Suprabhat 🙏", False, "greeting"),
    ("नमस्ते", False, "greeting"),
    ("", False, "no_content"),
    (None, False, "no_content"),
    ("Forwarded many times: ", False, "no_content"),
    ("ok fine", False, "too_short"),
    ("Rabb sabnu khush rakhe", False, "too_short"),
    ("Lemon water cures all cancer", True, "too_short"),
    ("Good morning. Lemon water cures all cancer", True, "too_short"),
    ("forward this to ten people", False, "too_short"),
    ("नींबू पानी से कैंसर ठीक होता है", True, "too_short"),
]


@query("worthy_cases", f"SELECT id::BIGINT AS id, worthy, why FROM {spelled([(i, w, y) for i, (_, w, y) in enumerate(WORTHY)], 'id, worthy, why')}")
def worthy_cases(spark, sf_dir):
    """N-18, N-19."""
    rows = spark.createDataFrame([(i, m) for i, (m, _, _) in enumerate(WORTHY)], "id bigint, m string")
    return rows.select("id", C.check_worthy(F.col("m")).alias("worthy"), C.why_not_claim(F.col("m")).alias("why"))


LONG, SHORT = "The minister said that taxes will rise next year.", "Short one here now."
#: Message, tags of its words, claims as text@start-stop, unchecked sentences, claims by tags.
CLAIMS = [
    (f"{SHORT} {LONG}\nA b c", "BIIO" + "O" * 12, [f"{LONG}@20-{20 + len(LONG)}", f"{SHORT}@0-{len(SHORT)}"], [], [f"{SHORT}@0-{len(SHORT)}"]),
    (f"{SHORT} {LONG} A b c", "O" * 16, [f"{LONG}@20-{20 + len(LONG)}", f"{SHORT}@0-{len(SHORT)}"], [], [f"{LONG}@20-{20 + len(LONG)}"]),
    ("too short", "OO", ["too short@0-9"], [], ["too short@0-9"]),
    ("a b c d e. a b c d! a b c d ef? a b c d।", "B" * 18, ["a b c d ef?@20-31", "a b c d e.@0-10", "a b c d!@11-19"], ["a b c d।"], ["a b c d ef?@20-31", "a b c d e.@0-10", "a b c d!@11-19"]),
    ("", "", ["@0-0"], [], ["@0-0"]),
]


@query("claim_cases", f"SELECT id::BIGINT AS id, array_to_string(c, '|') AS claims, array_to_string(u::VARCHAR[], '|') AS unchecked, array_to_string(t, '|') AS tagged FROM {spelled([(i, c, u, t) for i, (_, _, c, u, t) in enumerate(CLAIMS)], 'id, c, u, t')}")
def claim_cases(spark, sf_dir):
    """N-17, N-20, N-21."""
    rows = spark.createDataFrame([(i, m, list(t)) for i, (m, t, _, _, _) in enumerate(CLAIMS)], "id bigint, m string, tags array<string>")
    shown = lambda c: F.array_join(F.transform(c["claims"], lambda x: F.concat(x["text"], F.lit("@"), x["start"].cast("string"), F.lit("-"), x["stop"].cast("string"))), "|")
    found = rows.select("id", C.claims(F.col("m")).alias("c"), C.tagged_claims(F.col("m"), F.col("tags")).alias("t"))
    return found.select("id", shown(F.col("c")).alias("claims"), F.array_join("c.unchecked", "|").alias("unchecked"), shown(F.col("t")).alias("tagged"))


@query(
    "message_sentences",
    r"""WITH s AS (SELECT conv_id, turn, unnest(regexp_split_to_array(regexp_replace(text, '([.!?।])\s+', '\1' || chr(10), 'g'), '\n+')) AS s FROM conversations)
    SELECT conv_id, turn, count(*) AS sentences, sum(length(trim(s, E' \t\n\r')))::BIGINT AS chars FROM s WHERE trim(s, E' \t\n\r') <> '' GROUP BY conv_id, turn""",
)
def message_sentences(spark, sf_dir):
    s = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(C.sentences(F.col("text"))).alias("s"))
    return s.groupBy("conv_id", "turn").agg(F.count("*").alias("sentences"), F.sum(F.length("s")).cast("bigint").alias("chars"))


#: Title, forms of the claim; grounded, by stem, mostly, by stem or acronym.
TITLES = [
    ("Bengaluru", ["Bangalore is hot"], True, True, True, True),
    ("Taj Mahal (mausoleum)", ["ताज महल", "taj mahal was a temple"], True, True, True, True),
    ("Taj Mahal", ["ताज महल"], False, False, False, False),
    ("List of", ["list of rivers"], False, False, False, False),
    ("Reserve Bank of India", ["rbi bans notes"], False, False, False, True),
    ("Prime Minister Narendra Modi", ["narendra modi is prime"], False, False, True, False),
    ("Vaccination", ["vaccine side effects"], True, True, True, True),
    ("Eat", ["eating"], False, False, False, False),
    ("Food", ["foods"], False, True, True, True),
]


@query("title_cases", f"SELECT id::BIGINT AS id, a, b, c, d FROM {spelled([(i, *r[2:]) for i, r in enumerate(TITLES)], 'id, a, b, c, d')}")
def title_cases(spark, sf_dir):
    """N-46, N-62."""
    rows = spark.createDataFrame([(i, r[0], r[1]) for i, r in enumerate(TITLES)], "id bigint, title string, forms array<string>")
    rules = {"a": T.grounded, "b": T.grounded_by_stem, "c": T.grounded_mostly, "d": T.grounded_or_acronym}
    return rows.select("id", *(f(F.col("title"), F.col("forms")).alias(n) for n, f in rules.items()))


#: Forms, language, queries, deeper queries.
SEARCHES = [
    (["Cancer is cured by lemon water"], "en", ["en:cancer OR cured OR lemon OR water"], ["en:cancer OR cured OR lemon OR water", 'en:"Cancer"']),
    (["नींबू पानी", "lemon water", "lemon water"], "hi", ["hi:नींबू OR पानी", "en:lemon OR water"], ["hi:नींबू OR पानी", "en:lemon OR water"]),
    (["नींबू"], "fr", ["en:नींबू"], ["en:नींबू"]),
    (["is it"], "en", [], []),
    (
        ["Atal Pension Yojana gives UPI money says Reserve Bank of India"], "en", ["en:atal OR bank OR gives OR india OR money OR pension OR reserve OR says"],
        ["en:atal OR bank OR gives OR india OR money OR pension OR reserve OR says", 'en:"Reserve Bank of India" "Atal Pension Yojana"', "en:UPI"],
    ),
]


@query("search_cases", f"SELECT id::BIGINT AS id, array_to_string(q::VARCHAR[], '|') AS queries, array_to_string(d::VARCHAR[], '|') AS deeper FROM {spelled([(i, q, d) for i, (_, _, q, d) in enumerate(SEARCHES)], 'id, q, d')}")
def search_cases(spark, sf_dir):
    """N-47."""
    rows = spark.createDataFrame([(i, f, lang) for i, (f, lang, _, _) in enumerate(SEARCHES)], "id bigint, forms array<string>, lang string")
    shown = lambda q: F.array_join(F.transform(q, lambda x: F.concat(x["lang"], F.lit(":"), x["query"])), "|")
    return rows.select("id", *(shown(f(F.col("forms"), F.col("lang"))).alias(n) for n, f in (("queries", T.queries), ("deeper", T.deeper_queries))))


LEXICON = [("दिल्ली", "dilli", 3), ("दिल्ली", "delhi", 5), ("दिल्ली", "new delhi", 9), ("ताज", "taj", 4), ("ताज", "taaj", 4), ("तज", "taj", 2)]
#: Text, by rule, with the lexicon.
ROMAN = [
    ("नमस्ते करना", "namaste karna", "namaste karna"),
    ("राम नरेन्द्र सच", "raam narendra sach", "raam narendra sach"),
    ("मुंबई  ज़रूरी ख़बर", "munbai zaroori khabar", "munbai zaroori khabar"),
    ("(दिल्ली), ताज!", "(dilli), taaj!", "(delhi), taj!"),
    ("ਪੱਕਾ ਪੰਜਾਬ ਸਤਿ", "pakka panjaab sati", "pakka panjaab sati"),
    ("१२३। hello COVID-19", "123. hello COVID-19", "123. hello COVID-19"),
    ("", "", ""),
    (None, "", ""),
]


@query("romanise_cases", f"SELECT id::BIGINT AS id, r AS by_rule, l AS by_lexicon FROM {spelled([(i, r, x) for i, (_, r, x) in enumerate(ROMAN)], 'id, r, l')}")
def romanise_cases(spark, sf_dir):
    """N-25."""
    rows = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(ROMAN)], "id bigint, t string")
    lexicon = spark.createDataFrame(LEXICON, "native string, roman string, n bigint")
    return I.romanised(rows, "id", "t").withColumnRenamed("out", "by_rule").join(I.romanised(rows, "id", "t", lexicon).withColumnRenamed("out", "by_lexicon"), "id")


#: Text, language, by rule, with the lexicon.
NATIVE = [
    ("hai sach hi", "hi", "है सच ही", "है सच ही"),
    ("modi ne 5 kaha!", "hi", "मोदी ने 5 कहा!", "मोदी ने 5 कहा!"),
    ("taj mahal", "hi", "तज महल", "ताज महल"),
    ("zindagi karna", "hi", "ज़िन्दगी कर्ना", "ज़िन्दगी कर्ना"),
    ("Sat ek", "pa", "ਸਤ ਏਕ", "ਸਤ ਏਕ"),
    ("hello", "en", "hello", "hello"),
    ("", "hi", "", ""),
]


@query("native_cases", f"SELECT id::BIGINT AS id, r AS by_rule, l AS by_lexicon FROM {spelled([(i, *(unicodedata.normalize('NFC', x) for x in r[2:])) for i, r in enumerate(NATIVE)], 'id, r, l')}")
def native_cases(spark, sf_dir):
    """N-26."""
    rows = spark.createDataFrame([(i, r[0], r[1]) for i, r in enumerate(NATIVE)], "id bigint, t string, lang string")
    lexicon = spark.createDataFrame(LEXICON, "native string, roman string, n bigint")
    return I.to_native(rows, "id", "t", "lang").withColumnRenamed("out", "by_rule").join(I.to_native(rows, "id", "t", "lang", lexicon).withColumnRenamed("out", "by_lexicon"), "id")


#: Text, first label and p, second label and p; by both; by the first alone.
LANGUAGES = [
    ("   ", "en", 0.9, "en", 0.9, "other", 0.0, "other", 0.0),
    ("नमस्ते दुनिया", "en", 0.9, "en", 0.9, "hi", 1.0, "hi", 1.0),
    ("ਸਤਿ ਸ੍ਰੀ", "en", 0.9, "en", 0.9, "pa", 1.0, "pa", 1.0),
    ("12 ?!", "en", 0.9, "en", 0.9, "other", 0.0, "other", 0.0),
    ("bonjour le monde", "fr", 0.99, "en", 0.9, "other", 0.99, "other", 0.99),
    ("rabb rakha ji", "fr", 0.2, "pa", 0.8, "pa", 0.8, "other", 0.2),
    ("rabb rakha", "sw", 0.4, "pa", 0.3, "other", 0.3, "other", 0.4),
    ("hello world", "en", 0.9, "en", 0.7, "en", 0.7, "en", 0.9),
    ("hello world", "en", 0.2, "hi", 0.4, "hi", 0.4, "other", 0.2),
]


@query("language_cases", f"SELECT id::BIGINT AS id, l AS lang, c AS confidence, f AS first_lang, g AS first_confidence FROM {spelled([(i, *r[5:]) for i, r in enumerate(LANGUAGES)], 'id, l, c, f, g')}")
def language_cases(spark, sf_dir):
    """N-23."""
    c = F.col
    rows = spark.createDataFrame([(i, *r[:5]) for i, r in enumerate(LANGUAGES)], "id bigint, t string, top string, p double, roman string, rp double")
    both = rows.select("id", I.language(c("t"), c("top"), c("p"), c("roman"), c("rp")).alias("a"), I.language(c("t"), c("top"), c("p")).alias("b"))
    return both.select("id", "a.lang", "a.confidence", c("b.lang").alias("first_lang"), c("b.confidence").alias("first_confidence"))


#: Text, language by a scorer; language, script, transliterated.
READ = [
    ("modi ne kaha", "hi", "hi", "latn", "मोदी ने कहा"),
    ("मोदी", "hi", "hi", "deva", None),
    ("hello", "en", "en", "latn", None),
    ("123", "pa", "pa", "latn", None),
    ("ਸਤਿ ਸ੍ਰੀ", None, "pa", "guru", None),
    ("hello there", None, "en", "latn", None),
]


@query("preprocess_cases", f"SELECT id::BIGINT AS id, l AS lang, s AS script, t AS transliterated FROM {spelled([(i, *r[2:]) for i, r in enumerate(READ)], 'id, l, s, t')}")
def preprocess_cases(spark, sf_dir):
    """N-22, N-24."""
    return I.preprocessed(spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(READ)], "id bigint, t string, lang string"), "id", "t", "lang")


HEADS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in A.VERDICT.items())


@query(
    "template_explanations",
    f"""WITH p AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r, CASE event_id % 4 WHEN 0 THEN 'supports it' WHEN 1 THEN 'contradicts it' ELSE 'is related but does not settle it' END AS s FROM events),
    h AS (SELECT c_custkey AS claim, CASE c_custkey % 4 WHEN 0 THEN 'Supported' WHEN 1 THEN 'Refuted' WHEN 2 THEN 'NEI' ELSE 'Other' END AS v, c_custkey % 3 = 0 AS abstained FROM customer),
    e AS (SELECT user_id, string_agg('[' || r || '] ' || event_type || event_id || ' ' || s, '; ' ORDER BY r) AS cited FROM p WHERE r <= 3 GROUP BY user_id)
    SELECT claim, CASE WHEN abstained THEN 'Not confident enough to judge this claim. Leaning: ' || CASE v WHEN 'NEI' THEN 'not enough evidence' ELSE lower(v) END ELSE CASE v {HEADS} ELSE '{A.VERDICT["NEI"]}' END END || CASE WHEN cited IS NULL THEN '. No sources were retrieved.' ELSE '. ' || cited || '.' END AS explanation
    FROM h LEFT JOIN e ON user_id = claim""",
)
def template_explanations(spark, sf_dir):
    """N-50: customers stand in for claims, their events for passages."""
    from veristrata.operators.retrieval import top_k

    e = F.col("event_id") % 4
    title = F.concat("event_type", F.col("event_id").cast("string")).alias("title")
    best = top_k(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value"), ["user_id"], "event_id", A.MOST_CITED, "value")
    p = best.groupBy(F.col("user_id").alias("claim")).agg(F.array_sort(F.collect_list(F.struct("rank", title, F.when(e == 0, "Supports").when(e == 1, "Refutes").when(e == 2, "Neutral").alias("stance")))).alias("passages"))
    k = F.col("c_custkey")
    h = table(spark, sf_dir, "customer").select(k.alias("claim"), F.when(k % 4 == 0, "Supported").when(k % 4 == 1, "Refuted").when(k % 4 == 2, "NEI").otherwise("Other").alias("v"), (k % 3 == 0).alias("abstained"))
    return h.join(p, "claim", "left").select("claim", A.explanation(F.col("v"), F.col("passages"), F.col("abstained")).alias("explanation"))


#: Raw justification, clean one, raw markup, clean one.
CLEANED = [
    ("According to the evidence, the 2nd QA pair shows it.", "The evidence shows it.", "<2en> a  b</s><pad>", "a b"),
    ("the questions and answers say no", "The evidence say no", "plain", "plain"),
    ("Q&As differ", "The evidence differ", "<s>x</s>", "x"),
    ("", "", "", ""),
    (None, "", None, ""),
]


@query("justification_cases", f"SELECT id::BIGINT AS id, j AS justification, m AS text FROM {spelled([(i, r[1], r[3]) for i, r in enumerate(CLEANED)], 'id, j, m')}")
def justification_cases(spark, sf_dir):
    """N-51."""
    rows = spark.createDataFrame([(i, r[0], r[2]) for i, r in enumerate(CLEANED)], "id bigint, j string, m string")
    return rows.select("id", A.justification(F.col("j")).alias("justification"), A.without_markup(F.col("m")).alias("text"))


@query(
    "evidence_texts",
    r"""SELECT o_orderkey, concat_ws(' ', CASE WHEN o_orderkey % 3 > 0 THEN 'Is ' || o_orderstatus || '?' END, CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END) AS evidence, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE o_orderstatus END AS passage,
    o_orderstatus || chr(10) || concat_ws(' ', CASE WHEN o_orderkey % 3 > 0 THEN 'Is ' || o_orderstatus || '?' END, CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END) AS pair FROM orders""",
)
def evidence_texts(spark, sf_dir):
    """N-36, N-55, N-56: order columns stand in for questions and answers."""
    k = F.col("o_orderkey")
    question = F.when(k % 3 > 0, F.concat(F.lit(" Is "), "o_orderstatus", F.lit("? "))).otherwise("  ")
    answer = F.when(k % 5 > 0, F.col("o_orderpriority"))
    e = A.evidence(question, answer, F.lit(""))
    kind = F.when(k % 2 == 0, "factcheck").otherwise("lead")
    return table(spark, sf_dir, "orders").select("o_orderkey", e.alias("evidence"), A.passage_text(kind, F.col("o_orderpriority"), F.col("o_orderstatus")).alias("passage"), A.pair_text(F.col("o_orderstatus"), e).alias("pair"))


@query(
    "shared_latin_overlap",
    """WITH w AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+|[0-9]+')) AS w FROM benchmark)
    SELECT a.item_id, round(len(list_intersect(a.w, b.w)) / greatest(len(list_distinct(list_concat(a.w, b.w))), 1), 6) AS overlap FROM w a JOIN w b ON b.item_id = a.item_id + 1""",
)
def shared_latin_overlap(spark, sf_dir):
    """N-59: of each item and the next."""
    b = table(spark, sf_dir, "benchmark")
    after = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return b.join(after, "item_id").select("item_id", F.round(A.shared_latin(F.col("text"), F.col("other")), 6).alias("overlap"))


WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"


@query("occlusion_variants", f"WITH w AS (SELECT item_id, {WORDS} AS w FROM benchmark), i AS (SELECT item_id, w, unnest(generate_series(1, len(w))) AS i FROM w) SELECT item_id, i - 1 AS dropped, md5(array_to_string(list_concat(w[:i - 1], w[i + 1:]), ' ')) AS text FROM i")
def occlusion_variants(spark, sf_dir):
    """N-60: each item without each of its words."""
    v = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(A.occluded(F.col("text"))).alias("dropped", "t"))
    return v.select("item_id", F.col("dropped").cast("bigint").alias("dropped"), F.md5("t").alias("text"))


@query(
    "top_influences",
    f"""WITH w AS (SELECT item_id, {WORDS} AS w FROM benchmark), x AS (SELECT item_id, i, 0.5 - length(w[i + 1]) * (i % 7) / 50.0 AS v FROM (SELECT item_id, w, unnest(generate_series(0, len(w) - 1)) AS i FROM w)),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(v, 9) DESC, i) AS t, row_number() OVER (PARTITION BY item_id ORDER BY round(v, 9), i) AS b FROM x)
    SELECT item_id, string_agg(i::VARCHAR, ',' ORDER BY i) FILTER (t <= 3 AND round(v, 9) > 0) AS top, string_agg(i::VARCHAR, ',' ORDER BY i) FILTER (b <= 3) AS bottom FROM r GROUP BY item_id""",
)
def top_influences(spark, sf_dir):
    """T-04, E-13: a scorer's probabilities without each word (a stand-in by length and place) to the words that matter."""
    words = F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "")
    without = F.transform(words, lambda w, i: F.length(w) * (i % 7) / 50.0 + 0.25)
    found = F.transform(A.influences(F.lit(0.75), without), lambda v: F.round(v, 9))
    shown = lambda c: F.array_join(F.transform(c, lambda i: i.cast("string")), ",")
    return table(spark, sf_dir, "benchmark").select("item_id", found.alias("v")).select("item_id", shown(A.top_words(F.col("v"))).alias("top"), shown(A.bottom_words(F.col("v"))).alias("bottom"))


#: Failed, sources disagree, passages as source:stance, category.
SILENT = [
    (True, False, ["wikipedia:Supports"], "INFRA"),
    (False, False, ["corpus:Supports"], "NO_SOURCE"),
    (False, False, [], "NO_SOURCE"),
    (False, False, ["wikipedia:", "factcheck_live:"], "NOT_JUDGED"),
    (False, True, ["wikipedia:Supports", "factcheck_live:Refutes"], "SOURCES_DISAGREE"),
    (False, False, ["wikipedia:Neutral", "factcheck_live:"], "BOTH_NEI"),
    (False, False, ["wikipedia:Neutral", "factcheck_live:Refutes"], "ONE_SIDED"),
    (False, False, ["wikipedia:odd"], "OTHER"),
]


@query("silence_cases", f"SELECT id::BIGINT AS id, c AS category FROM {spelled([(i, r[3]) for i, r in enumerate(SILENT)], 'id, c')}")
def silence_cases(spark, sf_dir):
    """N-61."""
    rows = spark.createDataFrame([(i, f, d, p) for i, (f, d, p, _) in enumerate(SILENT)], "id bigint, f boolean, d boolean, p array<string>")
    passages = F.transform("p", lambda x: F.struct(F.split_part(x, F.lit(":"), F.lit(1)).alias("source"), F.nullif(F.split_part(x, F.lit(":"), F.lit(2)), F.lit("")).alias("stance")))
    return rows.select("id", A.silence(F.col("f"), F.col("d"), passages).alias("category"))


#: Matched claim, P(contradiction), blocked.
GUARDED = [("It cures. Does it?", 0.95, True), ("Does it cure? It does.", 0.95, False), ("It cures.", 0.89, False), ("It cures.", None, False), ("", 0.95, False), (None, 0.95, False)]


@query("polarity_cases", f"SELECT id::BIGINT AS id, b AS blocked FROM {spelled([(i, r[2]) for i, r in enumerate(GUARDED)], 'id, b')}")
def polarity_cases(spark, sf_dir):
    """F-05."""
    return spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(GUARDED)], "id bigint, c string, p double").select("id", A.guard_blocks(F.col("c"), F.col("p")).alias("blocked"))


@query(
    "result_provenance",
    """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'predictions-missing' WHEN event_id % 3 = 0 THEN 'predictions-changed' WHEN event_id % 5 = 0 THEN 'config-missing' WHEN event_id % 7 = 0 THEN 'split-changed' WHEN event_id % 11 = 0 THEN 'inputs-same-lock-grew'
    WHEN event_id % 13 = 0 THEN 'config-invalid' WHEN event_id % 17 = 0 THEN 'config-changed' ELSE 'reproduces' END AS status FROM events""",
)
def result_provenance(spark, sf_dir):
    """N-64: divisors of event ids stand in for checks that fail."""
    e = F.col("event_id")
    hashed = F.when(e % 13 != 0, e % 17 != 0)
    return table(spark, sf_dir, "events").select("event_id", A.provenance(*(e % d != 0 for d in (2, 3, 5, 7, 11)), hashed).alias("status"))
