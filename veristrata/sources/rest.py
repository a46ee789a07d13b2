"""JSON over HTTP as tables: throttled, retried, cached (S-11), encyclopaedia search and fact-check reviews (S-12, S-13).

Requests are rows. All requests to a host go to one task, which keeps the gap between them; what was answered is kept in
a Parquet cache by the redacted URL, so a job that runs again asks only for the rest.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.functions.text import redacted_keys

# fixed values: seconds and retries
GAP, TIMEOUT, RETRIES, LONGEST_WAIT = 1.0, 4.0, 2, 5.0
AGENT = "veristrata (claim verification)"
ROWS = "url string, body string, error string"


def get_json(url: str, gap: float = GAP, last: dict | None = None, opener: Callable = urllib.request.urlopen, sleep: Callable = time.sleep, clock: Callable = time.monotonic) -> tuple[str | None, str | None]:
    """(body, error) of a URL: 429 and server errors are asked again, after what Retry-After says but LONGEST_WAIT at most; other
    answers without JSON are final or, if the line failed, asked again too."""
    last = {} if last is None else last
    host, error, began = urllib.parse.urlsplit(url).netloc, "no attempt", clock()
    for attempt in range(RETRIES + 1):
        if clock() - began > TIMEOUT * (RETRIES + 1):
            break
        sleep(max(0.0, last.get(host, float("-inf")) + gap - clock()))
        last[host] = clock()
        try:
            with opener(urllib.request.Request(url, headers={"User-Agent": AGENT}), timeout=TIMEOUT) as answer:
                text = answer.read().decode("utf-8")
            json.loads(text)
            return text, None
        except urllib.error.HTTPError as e:
            error = f"HTTP {e.code}"
            if e.code != 429 and e.code < 500:
                break
            after = (e.headers or {}).get("Retry-After") or ""
            sleep(min(float(after), LONGEST_WAIT) if after.isdigit() else 1.5 * (attempt + 1))
        except (OSError, ValueError) as e:
            error = type(e).__name__
            sleep(0.5 * (attempt + 1))
    return None, error


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-z]+://([^/?#]*)", 1))


def fetch(spark: SparkSession, requests: DataFrame, cache: str, gap: float = GAP) -> DataFrame:
    """(url, body, error) of requests(url), each distinct URL once; url is redacted. cache: a folder that all executors share.

    Answers go to the cache before the result is read from it, so a lost task asks its requests again and nothing else.
    A URL that failed has a null body and is asked again by the next job.
    """
    schema = "url string, body string"
    asked = requests.select(F.col("url").alias("full"), redacted_keys(F.col("url")).alias("url")).dropDuplicates(["url"])
    known = _cached(spark, cache, schema)
    new = asked.join(known.select("url"), "url", "left_anti")

    def run(batches):
        last: dict = {}
        for b in batches:
            done = [get_json(full, gap, last) for full in b.column("full").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("url"), pa.array([x for x, _ in done], pa.string()), pa.array([e for _, e in done], pa.string())], ["url", "body", "error"])

    hosts = new.repartition(_host(F.col("url"))).select("url", "full")
    attempt = hosts.mapInArrow(run, ROWS).withColumn("ok", F.col("body").isNotNull())
    stage = f"{cache}/attempts"
    attempt.write.mode("overwrite").parquet(stage)
    tried = spark.read.parquet(stage)
    tried.filter("ok").select("url", "body").write.mode("append").parquet(f"{cache}/answers")
    answers = _cached(spark, cache, schema)
    return asked.select("url").join(answers, "url", "left").join(tried.select("url", "error"), "url", "left")


def _cached(spark: SparkSession, cache: str, schema: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{cache}/answers")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        # a job that was cut off may have appended an answer twice
        return spark.read.schema(schema).parquet(f"{cache}/answers").dropDuplicates(["url"])
    return spark.createDataFrame([], schema)


def search_url(base: Column, query: Column, limit: int = 5) -> Column:
    return F.concat(base, F.lit(f"?action=query&list=search&format=json&srlimit={limit}&srprop=snippet&srsearch="), F.url_encode(query))


def leads_url(base: Column, titles: Column) -> Column:
    return F.concat(base, F.lit("?action=query&format=json&prop=extracts&exintro=1&explaintext=1&exlimit=max&redirects=1&titles="), F.url_encode(F.array_join(titles, "|")))


def english_url(base: Column, titles: Column) -> Column:
    return F.concat(base, F.lit("?action=query&format=json&prop=langlinks&lllang=en&lllimit=max&redirects=1&titles="), F.url_encode(F.array_join(titles, "|")))


def plain(html: Column) -> Column:
    """A snippet without tags and with its entities read, single spaces."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]*>", "")
    for name, ch in (("&quot;", '"'), ("&#0?39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.regexp_replace(t, name, ch)
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def searched(answers: DataFrame) -> DataFrame:
    """S-12: (url, pos, title, snippet) of search answers(url, body)."""
    hits = F.from_json("body", "query struct<search: array<struct<title: string, snippet: string>>>")["query"]["search"]
    return answers.select("url", F.posexplode(hits).alias("pos", "hit")).select("url", "pos", "hit.title", plain(F.col("hit.snippet")).alias("snippet"))


def page_texts(answers: DataFrame) -> DataFrame:
    """S-12: (title, lead, english) of lead or language-link answers(body); null where a page has none."""
    pages = F.map_values(F.from_json("body", "query struct<pages: map<string, struct<title: string, extract: string, langlinks: array<struct<`*`: string>>>>>")["query"]["pages"])
    p = answers.select(F.explode(pages).alias("p")).filter("p.title IS NOT NULL")
    return p.select("p.title", F.when(F.col("p.extract").isNotNull(), plain(F.col("p.extract"))).alias("lead"), F.get("p.langlinks", F.lit(0))["*"].alias("english"))


def reviews(answers: DataFrame) -> DataFrame:
    """S-13: (url, claim, publisher, title, review_url, rating, lang): a row for each review of each claim; the publisher's name,
    else its site; missing texts are empty."""
    schema = "claims array<struct<text: string, claimReview: array<struct<publisher: struct<name: string, site: string>, title: string, url: string, textualRating: string, languageCode: string>>>>"
    claims = answers.select("url", F.explode(F.from_json("body", schema)["claims"]).alias("c"))
    r = claims.select("url", F.coalesce("c.text", F.lit("")).alias("claim"), F.explode("c.claimReview").alias("r"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    name = F.coalesce(F.when(F.col("r.publisher.name") != "", F.col("r.publisher.name")), text("r.publisher.site"))
    return r.select("url", "claim", name.alias("publisher"), text("r.title").alias("title"), text("r.url").alias("review_url"), text("r.textualRating").alias("rating"), F.left(text("r.languageCode"), F.lit(2)).alias("lang"))
