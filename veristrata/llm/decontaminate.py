"""Benchmark decontamination with a distributed positional inverted index.

Test items are cut into windows of WINDOW words (an item of fewer words is one window). A first pass over the
documents counts the words and the test terms; in each window the two terms rarest in the corpus become its anchors.
A second pass stores postings of the anchor terms only: document, position, and the term numbers of the words around
it. Joined with the items' anchors on the term, with positions adjusted by the anchor's offset, the lists of a
window's two anchors are intersected by document and alignment; the stored surroundings then confirm the exact phrase.

proximity() finds passages with words put in, taken out or moved: a window of n words is near where n + 1 words in a
row hold all of its words, or all but one if it has LOOSE or more. One more anchor than words may be missing stands
in any such place, so postings of the anchors with the words around them decide it; windows with one word that the
corpus lacks count too. It is a table of its own, since the columns of report() are fixed.

Documents are named by a 128-bit hash of their text, so the postings of copies merge. Items are taken in blocks of at
most BLOCK_WORDS words, which bounds what each task is sent, however many items there are.

Null and empty texts have no words: no hits, not contaminated. Items without words match nothing; rows that repeat an
item count once. Repeated document rows give one row each. An empty benchmark gives zero hits everywhere.
"""

from __future__ import annotations

from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.llm import shared

WINDOW = 13
#: A document is contaminated if n_hit * RATIO >= n_words (fixed by the contract).
RATIO = 20
BLOCK_WORDS = 500_000
#: Windows of so many words are near a place that lacks one of them.
LOOSE = 6


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(shared.ALNUM_LOWER).split()


def blocks(benchmark: DataFrame, most: int = BLOCK_WORDS):
    """Lists of (item_id, words) with at most `most` words in all, one item at least."""
    block, size = [], 0
    for row in benchmark.select("item_id", "text").filter(F.col("text").isNotNull()).toLocalIterator():
        words = words_of(row.text)
        if block and size + len(words) > most:
            yield block
            block, size = [], 0
        if words:
            block.append((str(row.item_id), words))
            size += len(words)
    if block:
        yield block


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the text's key k1, k2."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("k2"), text).alias("k2"))


def counted(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """From keyed docs: rows (doc_id, k1, k2, n_words), and rows (term, n) of each task's counts."""

    def run(batches):
        total = np.zeros(len(terms) + 1, np.int64)
        for b in shared.slices(batches):
            n = []
            for text in b.column("text").to_pylist():
                words = words_of(text)
                n.append(len(words))
                total += np.bincount(np.fromiter(map(terms.get, words, repeat(len(terms))), np.int64, len(words)), minlength=len(total))
            none = pa.nulls(b.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("k1"), b.column("k2"), pa.array(n, pa.int64()), none, none], ["doc_id", "k1", "k2", "n_words", "term", "n"])
        at = np.flatnonzero(total[:-1])
        none = pa.nulls(len(at), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(at), pa.array(total[at])], ["doc_id", "k1", "k2", "n_words", "term", "n"])

    return shared.materialise(docs.withColumn("doc_id", F.col("doc_id").cast("bigint")).mapInArrow(run, "doc_id bigint, k1 bigint, k2 bigint, n_words bigint, term bigint, n bigint"), "counted")


def postings(docs: DataFrame, terms: dict[bytes, int], wanted: set[bytes], around: int = WINDOW - 1) -> DataFrame:
    """term, k1, k2, pos and ctx (int32 term numbers of the words from pos - around to pos + around; -1: no test term)."""

    def run(batches):
        for b in shared.slices(batches):
            rows = []
            for text, k1, k2 in zip(*(b.column(c).to_pylist() for c in ("text", "k1", "k2")), strict=True):
                words = words_of(text)
                if wanted.isdisjoint(words):
                    continue
                ids = np.full(len(words) + 2 * around, -1, np.int32)
                ids[around : around + len(words)] = np.fromiter(map(terms.get, words, repeat(-1)), np.int32, len(words))
                for pos, w in enumerate(words):
                    if w in wanted:
                        rows.append((terms[w], k1, k2, pos, ids[pos : pos + 2 * around + 1].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["term", "k1", "k2", "pos", "ctx"])

    found = docs.drop("doc_id").mapInArrow(run, "term bigint, k1 bigint, k2 bigint, pos bigint, ctx binary")
    return found.dropDuplicates(["term", "k1", "k2", "pos"])


def anchors(items: list[tuple[str, np.ndarray]], counts: np.ndarray, window: int = WINDOW) -> list[dict[int, tuple[int, ...]]]:
    """Per item: start of each window whose terms all occur -> positions of its two rarest terms."""
    out = []
    for _, ids in items:
        own = {}
        size = min(window, len(ids))
        for at in range(len(ids) - size + 1):
            n = counts[ids[at : at + size]]
            if n.all():
                own[at] = tuple(int(at + i) for i in sorted(range(size), key=lambda i: (n[i], i))[:2])
        out.append(own)
    return out


def matches(spark: SparkSession, docs: DataFrame, block: list[tuple[str, list[bytes]]], window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(documents with n_words, hits): hits are (k1, k2, item_id, lo, hi), runs of words inside occurrences of windows."""
    terms = {w: i for i, w in enumerate(dict.fromkeys(w for _, ws in block for w in ws))}
    items = [(name, np.array([terms[w] for w in ws], np.int32)) for name, ws in block]
    seen = counted(docs, terms)
    counts = np.zeros(len(terms), np.int64)
    for r in seen.filter("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("n")).collect():  # at most a row for each test term
        counts[r.term] = r.n
    chosen = anchors(items, counts, window)
    places = sorted({(int(items[i][1][p]), i, p) for i, own in enumerate(chosen) for ps in own.values() for p in ps})
    everyone = seen.filter("term IS NULL").select("doc_id", "k1", "k2", "n_words")
    if not places:
        return everyone, spark.createDataFrame([], "k1 bigint, k2 bigint, item_id string, lo bigint, hi bigint")
    names = list(terms)
    index = postings(docs, terms, {names[t] for t, _, _ in places}, window - 1)
    # at most two places for each word of the block, so they are broadcast and no term's postings meet in one task
    lists = index.join(F.broadcast(spark.createDataFrame(places, "term bigint, item bigint, at bigint")), "term")
    aligned = lists.groupBy("item", "k1", "k2", (F.col("pos") - F.col("at")).alias("shift")).agg(F.collect_list(F.struct("at", "ctx")).alias("hits"))

    def confirm(batches):
        for b in shared.slices(batches):
            rows = []
            for r in b.to_pylist():
                name, ids = items[r["item"]]
                hits = {h["at"]: np.frombuffer(h["ctx"], np.int32) for h in r["hits"]}
                size, runs = min(window, len(ids)), []
                for at, ps in chosen[r["item"]].items():
                    if all(p in hits for p in ps):
                        lo = at - ps[0] + window - 1
                        if np.array_equal(hits[ps[0]][lo : lo + size], ids[at : at + size]):
                            if runs and at <= runs[-1][1]:
                                runs[-1][1] = at + size
                            else:
                                runs.append([at, at + size])
                rows += [(r["k1"], r["k2"], name, r["shift"] + lo, r["shift"] + hi) for lo, hi in runs]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["k1", "k2", "item_id", "lo", "hi"])

    return everyone, aligned.mapInArrow(confirm, "k1 bigint, k2 bigint, item_id string, lo bigint, hi bigint")


def near(spark: SparkSession, docs: DataFrame, block: list[tuple[str, list[bytes]]], window: int = WINDOW) -> DataFrame:
    """(k1, k2, item_id, first_word) of keyed docs with a place near a window of an item; several rows a pair."""
    terms = {w: i for i, w in enumerate(dict.fromkeys(w for _, ws in block for w in ws))}
    items = [(name, [terms[w] for w in ws]) for name, ws in block]
    counts = [0] * len(terms)
    for r in counted(docs, terms).filter("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("n")).collect():  # at most a row for each test term
        counts[r.term] = r.n
    # per item: term -> starts of the windows of which it is an anchor
    chosen: list[dict[int, list[int]]] = []
    for _, ids in items:
        own: dict[int, list[int]] = {}
        size = min(window, len(ids))
        spare = int(size >= LOOSE)
        for at in range(len(ids) - size + 1):
            there = sorted((t for t in ids[at : at + size] if counts[t]), key=lambda t: (counts[t], t))
            if len(there) >= size - spare:
                for t in dict.fromkeys(there[: spare + 1]):
                    own.setdefault(t, []).append(at)
        chosen.append(own)
    places = [(t, i) for i, own in enumerate(chosen) for t in own]
    schema = "k1 bigint, k2 bigint, item_id string, first_word bigint"
    if not places:
        return spark.createDataFrame([], schema)
    names = list(terms)
    lists = postings(docs, terms, {names[t] for t, _ in places}, window).join(F.broadcast(spark.createDataFrame(places, "term bigint, item bigint")), "term")

    def confirm(batches):
        members = [frozenset(ids) for _, ids in items]
        for b in shared.slices(batches):
            rows = []
            for r in b.to_pylist():
                name, ids = items[r["item"]]
                size = min(window, len(ids))
                need = size - (size >= LOOSE)
                around = np.frombuffer(r["ctx"], np.int32).tolist()
                if sum(map(members[r["item"]].__contains__, around)) < need:
                    continue
                first = None
                for at in chosen[r["item"]][r["term"]]:
                    wanted = Counter(ids[at : at + size])
                    for lo in range(max(window - size, window - r["pos"]), window + 1 if first is None else first):
                        span = around[lo : lo + size + 1]
                        if sum(min(n, span.count(t)) for t, n in wanted.items()) >= need:
                            first = lo
                            break
                if first is not None:
                    rows.append((r["k1"], r["k2"], name, r["pos"] - window + first))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["k1", "k2", "item_id", "first_word"])

    return lists.select("k1", "k2", "term", "item", "pos", "ctx").mapInArrow(confirm, schema)


def proximity(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id and first_word (where the earliest near place begins) of every row of docs near a window of an item."""
    spark, docs = docs.sparkSession, keyed(docs)
    hits = spark.createDataFrame([], "k1 bigint, k2 bigint, item_id string, first_word bigint")
    for block in blocks(benchmark, block_words):
        hits = hits.unionByName(shared.materialise(near(spark, docs, block, window), "near"))
    hits = hits.groupBy("k1", "k2", "item_id").agg(F.min("first_word").alias("first_word"))
    return docs.drop("text").join(hits, ["k1", "k2"]).select("doc_id", "item_id", "first_word")


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, ratio: int = RATIO, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, k1, k2, n_words, n_hit, n_items, items_sha256 and contaminated of every row of docs(doc_id, text)."""
    spark, docs = docs.sparkSession, keyed(docs)
    everyone, hits = None, None
    for block in blocks(benchmark, block_words):
        seen, found = matches(spark, docs, block, window)
        everyone, hits = everyone or seen, found if hits is None else hits.unionByName(shared.materialise(found, "hits"))
    if everyone is None:
        everyone, hits = matches(spark, docs, [], window)
    step = lambda a, r: F.struct(F.greatest(a["end"], r["hi"]).alias("end"), (a["n"] + F.greatest(F.lit(0), r["hi"] - F.greatest(a["end"], r["lo"]))).alias("n"))
    start = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n"))
    n_hit = F.aggregate(F.sort_array("runs"), start, step, lambda a: a["n"])
    hits = hits.groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "hi")).alias("runs"), F.collect_set("item_id").alias("items"))
    hits = hits.select("k1", "k2", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.array_join(F.sort_array("items"), ",").alias("items"))
    out = everyone.join(hits, ["k1", "k2"], "left").fillna({"n_hit": 0, "n_items": 0, "items": ""})
    out = out.withColumn("contaminated", (F.col("n_hit") > 0) & (ratio * F.col("n_hit") >= F.col("n_words")))
    return out.select("doc_id", "k1", "k2", "n_words", "n_hit", "n_items", F.sha2("items", 256).alias("items_sha256"), "contaminated")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark")).drop("k1", "k2")


def op9_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proximity matches beside op9_decontamination's exact ones, as a table of (document, item)."""
    return proximity(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that aren't contaminated, all columns as they are."""
    bad = shared.materialise(report(docs, benchmark, **options).filter("contaminated").select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).distinct(), "contaminated")
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = shared.as_row(docs, _k1=F.xxhash64(text), _k2=F.xxhash64(F.lit("k2"), text))
    return shared.from_row(marked.join(bad, ["_k1", "_k2"], "left_anti"), docs)
