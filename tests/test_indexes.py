"""Indexes, caches, registries, configurations, reports and HTTP sources on files and a server made here."""

import hashlib
import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from veristrata.operators import samples
from veristrata.sources import indexes as X
from veristrata.sources import reports as P
from veristrata.sources import rest


def test_index_comes_back(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "key int, text string")
    path = f"file://{tmp_path}/index"
    with pytest.raises(FileNotFoundError):
        X.read_index(spark, path)
    X.write_index({"docs": docs, "vectors": docs.select("key")}, path, {"encoder": "e"})
    parts = X.read_index(spark, path, same=("docs", "vectors"))
    hits = spark.createDataFrame([(3, 1), (9, 2)], "key int, rank int")
    assert sorted(map(tuple, X.lookup(hits, parts["docs"], "key").collect())) == [(3, 1, "t3"), (9, 2, None)]
    docs.limit(2).write.mode("overwrite").parquet(f"{path}/vectors")
    with pytest.raises(ValueError, match="manifest says"):
        X.read_index(spark, path)


def test_vectors_are_kept_by_text(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    docs = spark.createDataFrame([("a", "one"), ("b", "two")], "key string, text string")
    cache = X.VectorCache(spark, path, {"encoder": "e", "chars": 10})
    new = cache.missing(docs)
    assert new.count() == 2
    cache.upsert(new.select("key", "text_sha1", F.array(F.lit(1.0)).cast("array<float>").alias("vector")))
    changed = spark.createDataFrame([("a", "one"), ("b", "other"), ("c", "three")], "key string, text string")
    again = cache.missing(changed)
    assert sorted(r.key for r in again.collect()) == ["b", "c"]
    cache.upsert(again.select("key", "text_sha1", F.array(F.lit(2.0)).cast("array<float>").alias("vector")))
    assert {r.key: r.vector[0] for r in cache.vectors().collect()} == {"a": 1.0, "b": 2.0, "c": 2.0}
    with pytest.raises(ValueError, match="other settings"):
        X.VectorCache(spark, path, {"encoder": "f", "chars": 10})
    off = X.VectorCache(spark, path, {"encoder": "f"}, "off")
    assert off.vectors().count() == 0 and off.missing(docs).count() == 2
    kept = X.VectorCache(spark, path, {"encoder": "e", "chars": 10}, "readonly")
    kept.upsert(again.select("key", "text_sha1", F.array(F.lit(3.0)).cast("array<float>").alias("vector")))
    assert kept.vectors().filter("vector[0] = 3").count() == 0


def test_registry(spark, tmp_path):
    known = X.Registry()
    (tmp_path / "a.txt").write_text("x\n")
    here, gone = f"file://{tmp_path}/a.txt", f"file://{tmp_path}/b.txt"
    known.add("here", here)(lambda s, p: s.read.text(p))
    known.add("gone", here, gone)(lambda s, p, q: s.read.text(p))
    assert known.available(spark) == ["here"] and known.missing(spark, "gone") == [gone]
    assert known.load(spark, "here").count() == 1
    with pytest.raises(FileNotFoundError):
        known.load(spark, "gone")
    with pytest.raises(KeyError):
        known.load(spark, "other")


def test_sums_of_files(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"one")
    (tmp_path / "b").write_bytes(b"two")
    listed = [("a", 3, hashlib.sha256(b"one").hexdigest()), ("b", 3, hashlib.sha256(b"tw0").hexdigest()), ("c", 1, "")]
    found = X.incomplete(spark, f"file://{tmp_path}", spark.createDataFrame(listed, "name string, length bigint, sha256 string"))
    assert sorted(r.name for r in found.collect()) == ["b", "c"]


SCHEMA = {
    "type": "object", "required": ["task"], "additionalProperties": False,
    "properties": {"task": {"enum": ["a", "b"]}, "n": {"type": "integer", "minimum": 1}, "names": {"type": "array", "items": {"type": "string", "pattern": "^x"}}, "t": {"anyOf": [{"type": "null"}, {"type": "number", "maximum": 1}]}},
}


@pytest.mark.parametrize("text, fault", [("task: a\nn: 2\nnames: [x1]\nt: null", None), ("n: 2", "task is required"), ("task: c", "not one of"), ("task: a\nn: true", "not of type"), ("task: a\nn: 0", "n: under 1"),
                                         ("task: a\nnames: [x, y]", "names/1"), ("task: a\nt: 2", "none of its forms"), ("task: a\nmore: 1", "not known"), ("- 1", "not a mapping"), ("a: [", "not YAML")])
def test_configurations(spark, tmp_path, text, fault):
    (tmp_path / "c.yaml").write_text(text)
    path = f"file://{tmp_path}/c.yaml"
    if fault is None:
        assert P.read_config(spark, path, SCHEMA, {"n": 1, "k": 5}) == {"task": "a", "n": 2, "names": ["x1"], "t": None, "k": 5}
    else:
        with pytest.raises(P.Refused, match=fault):
            P.read_config(spark, path, SCHEMA)


def test_results_and_tables(spark, tmp_path):
    name = P.run_hash({"b": 1, "a": "é"}, "p", None)
    assert name == hashlib.sha256('{"a":"é","b":1}'.encode() + b"p" + b"nolock").hexdigest()[:12]
    path = P.write_result(spark, f"file://{tmp_path}", {"config_hash": name, "b": 1, "a": [2]})
    assert (tmp_path / f"{name}.json").read_text() == json.dumps({"a": [2], "b": 1, "config_hash": name}, indent=2) + "\n"
    assert P.read_json(spark, path)["a"] == [2]
    runs = [
        {"experiment": "e", "task": "transliteration", "metrics": {"overall": {"cer": 0.25, "n": 4}}, "delta_vs_baseline": {"cer": -0.5}, "baseline": {"name": "identity"}, "warnings": ["w"], "coverage": {"n_missing": 2},
         "native_vs_romanized": {"metric": "cer", "by_lang": {"hi": {"native": 0.1, "romanized": 0.3, "gap": -0.2, "n_native": 3, "n_romanized": 4}, "en": {"native": 0.1}}}},
        {"experiment": "f", "task": "odd"},
    ]
    assert P.results_table(runs).splitlines()[2:] == [
        "| e | transliteration | cer | 0.2500 | identity | 0.7500 | -0.5000 | 4 | lower is better, 1 warning(s), 2 uncovered |",
        "| f | odd | — | — | — | — | — | — | no headline for this task |",
    ]
    assert P.gaps_table(runs).splitlines()[2:] == ["| e | hi | cer | 0.1000 | 0.3000 | -0.2000 | 3 | 4 |"]
    assert P.gaps_table(runs[1:]).startswith("_No run")


def test_test_splits_are_locked(spark, monkeypatch):
    rows = spark.createDataFrame([("a:en:dev:0",), ("a:en:test:1",)], "uid string")
    monkeypatch.delenv(samples.ALLOW, raising=False)
    with pytest.raises(PermissionError):
        samples.require_allowed(rows)
    with pytest.raises(PermissionError):
        samples.require_allowed(rows.limit(0), "x/test.jsonl")
    assert samples.require_allowed(rows.filter("uid like '%dev%'"), "x/dev.jsonl").count() == 1
    monkeypatch.setenv(samples.ALLOW, "1")
    assert samples.require_allowed(rows).count() == 2


def test_pools_of_two_stores_are_refused(spark):
    rows = spark.createDataFrame([("s:train.json:1",), ("s:dev.json:1",)], "source_id string")
    with pytest.raises(ValueError, match="more than one store"):
        samples.with_pools(rows, spark.createDataFrame([("dev", 1, "p")], "store string, claim_idx bigint, p string"))


@pytest.fixture()
def server():
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            n = asked.count(self.path)
            if "flaky" in self.path and n == 1:
                self.send_response(503)
                self.send_header("Retry-After", "0")
                self.end_headers()
            elif "gone" in self.path:
                self.send_response(404)
                self.end_headers()
            else:
                body = {"query": {"search": [{"title": "T", "snippet": "<b>a</b> &amp; b"}]}} if "search" in self.path else {"claims": [{"text": "c", "claimReview": [{"publisher": {"site": "s"}, "textualRating": "False", "languageCode": "en-IN"}, {"publisher": {"name": "n"}, "url": "u"}]}, {"text": "none"}]}
                self.send_response(200)
                self.end_headers()
                self.wfile.write(json.dumps(body).encode())

        def log_message(self, *args):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", asked
    s.shutdown()


def test_answers_are_kept(spark, tmp_path, server):
    base, asked = server
    urls = [f"{base}/flaky?a=1&key=secret", f"{base}/search", f"{base}/gone", f"{base}/search"]
    requests = spark.createDataFrame([(u,) for u in urls], "url string")
    cache = f"file://{tmp_path}/http"
    first = {r.url: r for r in rest.fetch(spark, requests, cache, gap=0.0).collect()}
    assert len(first) == 3 and first[f"{base}/gone"].body is None and first[f"{base}/gone"].error == "HTTP 404"
    assert "secret" not in "".join(f.read_bytes().decode("latin-1") for f in (tmp_path / "http").rglob("*.parquet"))
    assert sum("flaky" in a for a in asked) == 2 and sum("search" in a for a in asked) == 1
    again = rest.fetch(spark, requests, cache, gap=0.0)
    assert sum("search" in a for a in asked) == 1 and sum("gone" in a for a in asked) == 2
    found = rest.searched(again.filter("url like '%search%'")).collect()
    assert [(r.pos, r.title, r.snippet) for r in found] == [(0, "T", "a & b")]
    reviews = rest.reviews(again.filter("url like '%flaky%'")).orderBy("publisher").collect()
    assert [tuple(r)[1:] for r in reviews] == [("c", "n", "", "u", "", ""), ("c", "s", "", "", "False", "en")]


def test_page_texts(spark):
    body = json.dumps({"query": {"pages": {"1": {"title": "A", "extract": " x  y ", "langlinks": [{"*": "E"}]}, "2": {"title": "B"}, "3": {"missing": ""}}}})
    rows = rest.page_texts(spark.createDataFrame([(body,)], "body string")).orderBy("title").collect()
    assert [tuple(r) for r in rows] == [("A", "x y", "E"), ("B", None, None)]


def test_waits():
    slept, now = [], [0.0]

    class Failing:
        def __call__(self, *args, **kwargs):
            raise TimeoutError

    def sleep(s):
        slept.append(s)
        now[0] += s

    assert rest.get_json("http://h/x", 1.0, {}, Failing(), sleep, lambda: now[0]) == (None, "TimeoutError")
    assert slept == [0.0, 0.5, 0.5, 1.0, 0.0, 1.5]
