"""All texts whose sets of grams have a share in common: links of J >= 9/10 without a miss (L-02).

Sets a and b of that share differ in (|a| + |b|) / 19 grams at most. Grams are dealt by hash to more parts than that, so two
such sets are equal in some part: they meet in the sum of its hashes. Sizes lie in classes, each with its number of parts, and
a set goes to its own class and, if a set of the next can be near it, to the next. Sets that meet are compared gram by gram.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veristrata.operators import simhash as S

#: Characters of a gram; growth of a class's largest size; parts beyond the least in classes from SPARE_FROM, so that sets
#: with few empty parts need not meet in these.
GRAM, GROWTH, SPARE, SPARE_FROM = 5, 1.45, 2, 60
#: Texts of a slice whose keys are dealt together, and keys that a task sorts together, about.
SLICE_CHARS, BUCKET_KEYS = 4_000_000, 1_500_000
#: Pairs that are sent to all tasks at most.
MOST_SENT = 500_000

SIZES = [1]
while SIZES[-1] < 1 << 31:
    SIZES.append(max(SIZES[-1] + 1, int(SIZES[-1] * GROWTH)))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one mixture of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(text: str) -> np.ndarray:
    """Hashes of the text's distinct grams in order; a shorter text is one gram."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(c) < GRAM:
        c = np.concatenate([c, np.full(GRAM - len(c), 0x1FFFFF, np.uint64)])
    n, b = len(c) - GRAM + 1, np.uint64(21)
    low = ((c[:n] << b | c[1 : n + 1]) << b) | c[2 : n + 2]
    return np.unique(_mixed(low ^ _mixed((c[3 : n + 3] << b | c[4 : n + 4]) + np.uint64(0x9E3779B97F4A7C15))))


def _parts(size: int) -> tuple[int, int]:
    """Parts of a class whose largest size is given, and how many of them two near sets have in common at least."""
    differ = 2 * size // 19
    spare = SPARE if size >= SPARE_FROM else 0
    return differ + 1 + spare, 1 + spare


def keys(text: str) -> tuple[int, np.ndarray]:
    """The size of a text's set and the keys in which it meets every set that has 9/10 in common with it."""
    h = _hashes(text)
    n, at = len(h), bisect_left(SIZES, len(h))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(h + np.uint64(1)), dtype=np.uint64)])
    found = []
    for j in (at, at + 1):
        if j > at and 10 * n < 9 * (SIZES[at] + 1):
            break
        k, common = _parts(SIZES[j])
        edges = np.array([(i << 64) // k for i in range(1, k)], np.uint64)
        cut = np.concatenate([[0], np.searchsorted(h, edges), [n]])
        key = _mixed((sums[cut[1:]] - sums[cut[:-1]]) ^ _mixed(np.arange(k, dtype=np.uint64) + np.uint64(j << 40)))
        full = cut[1:] > cut[:-1]
        # without its empty parts it still has a part in common
        found.append(key[full] if k - full.sum() < common else key)
    return n, np.concatenate(found)


def _dealt(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, keys, ids, sizes) of the texts of slices, in packed form: one row for each bucket of a slice."""

    def packed(held):
        key, n = np.concatenate([k for _, _, k in held]), np.array([len(k) for _, _, k in held])
        doc, size = (np.repeat(np.array([x[i] for x in held], np.int64), n) for i in (0, 1))
        bucket = (key >> np.uint64(32)).astype(np.int64) % buckets
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        own = [i for i in range(buckets) if cut[i] < cut[i + 1]]
        parts = [[x[order[cut[i] : cut[i + 1]]].tobytes() for i in own] for x in (key, doc, size.astype(np.int32))]
        return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *(pa.array(p, pa.binary()) for p in parts)], ["bucket", "keys", "ids", "sizes"])

    held, chars = [], 0
    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
            t = text.as_py()
            if t:
                held.append((doc, *keys(t)))
                chars += len(t)
            if chars >= SLICE_CHARS:
                yield packed(held)
                held, chars = [], 0
    if held:
        yield packed(held)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ids, sizes) of the sets that meet in a key, once for a bucket; the rows come in order of their buckets."""
    rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(4))))
    for _, own in groupby(rows, lambda r: r[0]):
        own = list(own)
        key, doc, size = (np.frombuffer(b"".join(r[i] for r in own), t) for i, t in ((1, np.uint64), (2, np.int64), (3, np.int32)))
        order = np.lexsort((doc, key))
        key, doc, size = key[order], doc[order], size[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        end = np.concatenate([first[1:], [len(key)]])
        many = end - first > 1
        seen = {}
        for lo, hi in zip(first[many], end[many]):
            seen[doc[lo:hi].tobytes()] = (lo, hi)
        spans = list(seen.values())
        for at in range(0, len(spans), 10_000):
            part = spans[at : at + 10_000]
            ends = pa.array(np.cumsum([0, *(hi - lo for lo, hi in part)]), pa.int32())
            flat = [np.concatenate([x[lo:hi] for lo, hi in part]) for x in (doc, size)]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(x)) for x in flat], ["ids", "sizes"])


def meetings(docs: DataFrame, chars: int) -> DataFrame:
    """(ids, sizes) of sets of docs(id, text) that meet in keys, of some `chars` characters in all. Empty texts meet nothing."""
    buckets = max(docs.sparkSession.sparkContext.defaultParallelism, chars // 5 // BUCKET_KEYS)
    dealt = docs.mapInArrow(lambda b: _dealt(b, buckets), "bucket int, keys binary, ids binary, sizes binary")
    met = dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_met, "ids array<bigint>, sizes array<int>")
    return met.dropDuplicates(["ids"])


def sketch(text: str) -> bytes:
    """How many grams of the text fall to each of 256 buckets, 255 at most: two sets differ by no less than their sketches."""
    return np.minimum(np.bincount((_hashes(text) >> np.uint64(8)) & np.uint64(255), minlength=256), 255).astype(np.uint8).tobytes()


def sketched(docs: DataFrame) -> DataFrame:
    """docs(id, text) with their sketches, without empty texts."""

    def made(batches):
        for b in batches:
            yield b.append_column("sketch", pa.array([sketch(t) for t in b.column("text").to_pylist()], pa.binary()))

    return docs.select("id", "text").filter("text <> ''").mapInArrow(made, "id bigint, text string, sketch binary")


def likely(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs(a, b, m, n), m and n their sizes, whose sketches in docs(id, sketch) differ by (m + n) / 19 at most: no near pair is lost."""

    def kept(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, 256).astype(np.int16) for c in ("s", "t"))
            most = b.column("m").to_numpy().astype(np.int64) + b.column("n").to_numpy()
            yield b.select(["a", "b"]).filter(pa.array(19 * np.abs(x - y).sum(1, dtype=np.int64) <= most))

    both = pairs.join(docs.select(F.col("id").alias("a"), F.col("sketch").alias("s")), "a").join(docs.select(F.col("id").alias("b"), F.col("sketch").alias("t")), "b")
    return both.select("a", "b", "m", "n", "s", "t").mapInArrow(kept, "a bigint, b bigint")


def _near(x: str, y: str) -> str:
    """Whether sizes x and y allow a share of 9/10."""
    return f"10 * least({x}, {y}) >= 9 * greatest({x}, {y})"


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(x, y) of rows(a, id, text) in order of a, its own text first, that have 9/10 of their grams in common."""
    root, own, grams = None, "", set()
    for b in batches:
        found = []
        for a, i, text in zip(*(b.column(c).to_pylist() for c in range(3))):
            if i == a:
                root, own, grams = a, text, S._grams(text, GRAM)
                continue
            assert a == root
            other = grams if text == own else S._grams(text, GRAM)
            if 10 * min(len(grams), len(other)) >= 9 * max(len(grams), len(other)):
                both = len(grams & other)
                if 10 * both >= 9 * (len(grams) + len(other) - both):
                    found.append((a, i))
        yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in (0, 1)], ["x", "y"])


def compared(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The (x, y) of pairs(a, b) whose texts in docs(id, text) have 9/10 of their grams in common; a text goes once to each a."""
    pairs = pairs.checkpoint()
    wanted = pairs.select("a", F.col("b").alias("id")).unionByName(pairs.select("a", F.col("a").alias("id")).distinct())
    if pairs.count() <= MOST_SENT:
        wanted = F.broadcast(wanted)
    tasks = max(pairs.sparkSession.sparkContext.defaultParallelism, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.join(wanted, "id").select("a", "id", "text").repartition(tasks, "a")
    return rows.sortWithinPartitions("a", F.col("id") != F.col("a")).mapInArrow(_compared, "x bigint, y bigint")


def links(docs: DataFrame, chars: int) -> DataFrame:
    """Edges (x, y) between docs(id, text) that have 9/10 of their grams in common; what they connect is what all such pairs
    connect: a pair is left out only if its texts are connected by others.

    Where texts meet, the first is compared with the others; then all pairs that meet and are not connected yet.
    """
    spark = docs.sparkSession
    S._checkpoints(spark)
    # made once: normal forms take longer than all comparisons
    at = f"{spark.sparkContext.getCheckpointDir()}/texts-{uuid.uuid4().hex}"
    sketched(docs).write.parquet(at)
    docs = spark.read.parquet(at)
    met = meetings(docs.select("id", "text"), chars).withColumn("at", F.monotonically_increasing_id()).checkpoint()
    first = met.select(F.get("ids", F.lit(0)).alias("a"), F.get("sizes", F.lit(0)).alias("m"), F.explode(F.arrays_zip("ids", "sizes")).alias("z"))
    first = first.select("a", F.col("z.ids").alias("b"), "m", F.col("z.sizes").alias("n")).filter(f"a < b AND {_near('m', 'n')}")
    tried = likely(first.distinct(), docs).checkpoint()
    found = compared(tried, docs).checkpoint()
    labels = S.components(found)
    each = met.select("at", F.explode(F.arrays_zip("ids", "sizes")).alias("z")).select("at", F.col("z.ids").alias("v"), F.col("z.sizes").alias("n"))
    named = each.join(labels, "v", "left").withColumn("label", F.coalesce("label", "v"))
    open_ = named.groupBy("at").agg(F.collect_list(F.struct("v", "n", "label")).alias("p"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi")
    rest = open_.select("p", F.explode("p").alias("x")).select("x", F.explode("p").alias("y")).filter(f"x.v < y.v AND x.label <> y.label AND {_near('x.n', 'y.n')}")
    rest = rest.select(F.col("x.v").alias("a"), F.col("y.v").alias("b"), F.col("x.n").alias("m"), F.col("y.n").alias("n")).distinct()
    return found.unionByName(compared(likely(rest, docs).join(tried, ["a", "b"], "left_anti"), docs))
