"""Queries over texts, URLs and pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veristrata.functions import text as T
from veristrata.operators.retrieval import term_coverage
from veristrata.registry import query, spread, table

WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


@query("script_profile", r"""SELECT doc_id, length(regexp_replace(text, '[^A-Za-z\x{00C0}-\x{024F}]', '', 'g')) AS latn, 'latn' AS script, CASE WHEN regexp_matches(text, '[A-Za-z\x{00C0}-\x{024F}]') THEN 1.0 ELSE 0.0 END AS purity FROM documents""")
def script_profile(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.script_count(t, "latn").cast("bigint").alias("latn"), T.dominant_script(t).alias("script"), T.script_purity(t).alias("purity"))


@query("token_stats", f"SELECT lang, count(*) AS docs, sum(n) AS tokens, sum(d) AS distinct_in_doc FROM (SELECT lang, len({WORDS}) AS n, len(list_distinct({WORDS})) AS d FROM documents) GROUP BY lang")
def token_stats(spark, sf_dir):
    w = T.tokens(F.col("text"))
    d = table(spark, sf_dir, "documents").select("lang", F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d"))
    return d.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"), F.sum("d").alias("distinct_in_doc"))


@query("doc_frequency", f"SELECT term, count(*) AS df, sum(tf) AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({WORDS}) AS term FROM documents) GROUP BY ALL) GROUP BY term HAVING count(*) >= 2")
def doc_frequency(spark, sf_dir):
    # a document's own counts are made in its row, so that one shuffle, of partial sums, is all
    words = F.array_sort(T.tokens(F.col("text"))).alias("w")
    first = spread(table(spark, sf_dir, "documents").select("text")).select(words).select(F.inline(F.transform("w", lambda x, i: F.struct(x.alias("term"), ((i == 0) | (F.get("w", i - 1) != x)).alias("starts")))))
    starts = F.col("starts")
    return first.select("term", starts.cast("bigint").alias("new")).groupBy("term").agg(F.sum("new").alias("df"), F.count("*").alias("cf")).filter("df >= 2")


@query("sentence_stats", r"SELECT doc_id, len(s) AS sentences, list_max(list_transform(s, lambda x: length(x))) AS longest FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?।\n]+'), lambda x: trim(x)), lambda x: length(x) > 0) AS s FROM documents) WHERE len(s) > 0")
def sentence_stats(spark, sf_dir):
    s = F.filter(F.transform(F.split("text", r"[.!?।\n]+"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    d = table(spark, sf_dir, "documents").select("doc_id", s.alias("s")).filter(F.size("s") > 0)
    return d.select("doc_id", F.size("s").cast("bigint").alias("sentences"), F.array_max(F.transform("s", F.length)).cast("bigint").alias("longest"))


@query("claims_top3", r"""WITH s AS (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) AS pos FROM (SELECT doc_id, list_transform(regexp_split_to_array(text, '[.!?।\n]+'), lambda x: trim(x)) AS s FROM documents)), w AS (SELECT *, length(sentence) AS n FROM s WHERE len(regexp_extract_all(lower(sentence), '[\p{L}\p{N}_]+')) >= 4) SELECT doc_id, pos, sentence, rank FROM (SELECT doc_id, pos, sentence, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) AS rank FROM w) WHERE rank <= 3""")
def claims_top3(spark, sf_dir):
    s = F.transform(F.split("text", r"[.!?।\n]+"), lambda x: F.trim(x))
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(s).alias("pos", "sentence")).filter(F.size(T.tokens(F.col("sentence"))) >= 4)
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.length("sentence").desc(), "pos"))
    return d.select("doc_id", (F.col("pos") + 1).cast("bigint").alias("pos"), "sentence", rank.cast("bigint").alias("rank")).filter("rank <= 3")


@query("check_worthy_rate", r"SELECT role, count(*) AS n, sum(CASE WHEN len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) >= 4 THEN 1 ELSE 0 END) AS worthy FROM conversations GROUP BY role")
def check_worthy_rate(spark, sf_dir):
    worthy = (F.size(T.tokens(F.col("text"))) >= 4).cast("bigint")
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.sum(worthy).alias("worthy"))


@query("publisher_counts", r"SELECT regexp_replace(regexp_replace(regexp_replace(lower(url), '^[a-z]+://', ''), '[/?#].*$', ''), '^www\.', '') AS publisher, count(*) AS n FROM pages GROUP BY 1")
def publisher_counts(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(T.publisher(F.col("url")).alias("publisher")).agg(F.count("*").alias("n"))


@query("redact_urls", r"SELECT page_id, regexp_replace(url, '([?&](?:key|api_key)=)[^&]*', '\1***', 'g') AS url FROM pages")
def redact_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.redacted_keys(F.col("url")).alias("url"))


@query("fold_balance", "SELECT fold, count(*) AS n FROM (SELECT (('0x' || substr(sha256('42:' || doc_id), 1, 16))::UBIGINT % 5)::INT AS fold FROM documents) GROUP BY fold")
def fold_balance(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(T.fold(F.col("doc_id")).alias("fold")).agg(F.count("*").alias("n"))


@query("repetition_trigrams", f"SELECT doc_id, max(n) AS most FROM (SELECT doc_id, g, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) AS g FROM (SELECT doc_id, {WORDS} AS w FROM documents) WHERE len(w) >= 3) GROUP BY ALL) GROUP BY doc_id HAVING max(n) >= 3")
def repetition_trigrams(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("w")).filter(F.size("w") >= 3)
    g = d.select("doc_id", "w", F.explode(F.sequence(F.lit(0), F.size("w") - 3)).alias("i")).select("doc_id", F.concat_ws(" ", F.slice("w", F.col("i") + 1, 3)).alias("g"))
    return g.groupBy("doc_id", "g").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.max("n").alias("most")).filter("most >= 3")


@query("html_strip", r"SELECT page_id, length(t) AS n, sha1(t) AS sha1 FROM (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g')) AS t FROM pages)")
def html_strip(spark, sf_dir):
    t = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"[ \t\n\r]+", " "))
    return table(spark, sf_dir, "pages").select("page_id", F.length(t).cast("bigint").alias("n"), F.sha1(t).alias("sha1"))


#: Claims that go to every task at once.
CLAIMS_AT_ONCE = 5_000


@query("claim_coverage", f"WITH q AS (SELECT item_id, list_distinct(list_filter({WORDS}, lambda x: length(x) >= 3)) AS terms FROM benchmark), l AS (SELECT page_id, lower(html) AS p FROM pages) SELECT item_id, page_id, round(list_avg(list_transform(terms, lambda t: CASE WHEN contains(p, t) THEN 1.0 ELSE 0.0 END)), 6) AS coverage FROM q, l WHERE len(terms) > 0 AND list_avg(list_transform(terms, lambda t: CASE WHEN contains(p, t) THEN 1.0 ELSE 0.0 END)) >= 0.5")
def claim_coverage(spark, sf_dir):
    terms = F.array_distinct(F.filter(T.tokens(F.col("text")), lambda x: F.length(x) >= 3))
    q = table(spark, sf_dir, "benchmark").select("item_id", terms.alias("terms")).filter(F.size("terms") > 0)
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", F.array_distinct(T.tokens(F.col("html"))).alias("w"))
    # a stated query set against all pages, in blocks of a bounded size
    blocks = -(-q.count() // CLAIMS_AT_ONCE) or 1
    out = None
    for i in range(blocks):
        block = q if blocks == 1 else q.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i)
        found = term_coverage(pages, block, "item_id", "page_id", 0.5).select("item_id", "page_id", F.round("c", 6).alias("coverage"))
        out = found if out is None else out.unionByName(found)
    return out


@query("split_counts_grouping_sets", "SELECT lang, source, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY GROUPING SETS ((), (lang), (source), (lang, source))")
def split_counts_grouping_sets(spark, sf_dir):
    return table(spark, sf_dir, "documents").cube("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("dataset_profile", "SELECT lang, count(*) AS n, min(n_chars) AS shortest, round(median(n_chars), 4) AS median, round(avg(n_chars), 4) AS mean, max(n_chars) AS longest FROM documents GROUP BY lang")
def dataset_profile(spark, sf_dir):
    c = F.col("n_chars")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.min(c).alias("shortest"), F.round(F.median(c), 4).alias("median"), F.round(F.avg(c), 4).alias("mean"), F.max(c).alias("longest"))


@query("latency_percentiles", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS most FROM events GROUP BY event_type")
def latency_percentiles(spark, sf_dir):
    at = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY value)")
    # equal values are one entry of a group's buffer, so its size is that of the distinct values
    return table(spark, sf_dir, "events").groupBy("event_type").agg(at(0.5).alias("p50"), at(0.95).alias("p95"), F.max("value").alias("most"))


@query("json_props", "SELECT event_type, sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS k FROM events GROUP BY event_type")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("k"))


@query("keep_lowest_per_key", "SELECT lang, source, arg_min(doc_id, (n_chars, doc_id)) AS doc_id FROM documents GROUP BY lang, source")
def keep_lowest_per_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.min_by("doc_id", F.struct("n_chars", "doc_id")).alias("doc_id"))


@query("html_leads")
def html_leads(spark, sf_dir):
    """S-10, N-39, N-41: title, lead and passage spans of each page; a parser's work, held by tests instead of SQL."""
    from veristrata.sources import html

    parsed = html.leads(html.parsed_pages(table(spark, sf_dir, "pages").select("page_id", "html")))
    return parsed.select("page_id", "title", "lead", F.size("paragraphs").alias("paragraphs"), html.passage_spans(F.col("paragraphs")).alias("passages"))
