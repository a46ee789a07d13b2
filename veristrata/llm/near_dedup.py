"""MinHash near-duplicates by a signature-coordinate inverted join.

Every document's set of word shingles gets a signature of COORDINATES minima. Documents with equal sets are one class.
Each class is posted under its coordinate-value pairs; values that nobody shares are skipped, and so is a class that
shares fewer than MATCHES pairs. Of the others, only a prefix is posted: the n - MATCHES + 1 rarest of the n shared
pairs, which two classes with MATCHES collisions cannot both miss. Within a list, collisions are counted on the lowest
bytes of the signatures, and classes joined by MATCHES or more stay together; a list of over CELL classes stays whole.
The member with the largest lists in all is the hub, and a hub with all that meet it is a family, which holds every
candidate pair: a group of a thousand near copies is compared with its hub, not with itself. Members not linked to
their hub are then compared exactly with the whole family, in cells of bounded size. Links are confirmed on full sets;
only links that join something new locally are emitted. Components come from label propagation with pointer jumping
over written tables.

A pair of similarity 0.8 collides in 51 of 64 coordinates on average; it has under 30 with probability below 1e-8.
Sets are of 64-bit hashes. Rows with null or empty text have no shingles and are linked with nothing. A class's id is
its smallest doc_id, nulls last; rows that repeat a doc_id share its fate. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.llm import shared

COORDINATES, MATCHES = 64, 30
#: Links need so many hundredths of the union in common.
SIMILAR = 80
#: Words of a shingle: of the query (fixed by its contract) and elsewhere.
QUERY_WORDS, WORDS = 2, 5
#: Members of a family in one cell, and shingles of them all; both on average, as members are dealt to cells by hash.
CELL, CELL_SHINGLES = 1000, 1 << 20
MAX_ROUNDS = 60


class WordHashes(dict):
    def __missing__(self, word):
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words; of all words, if they are fewer."""
    words = text.encode().translate(shared.ASCII_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def signed(x) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def signatures(docs: DataFrame, size: int, coordinates: int = COORDINATES) -> DataFrame:
    """Of docs(doc_id, text, k1, k2): doc_id, k1, k2, n, the set's key (a, b) and the signature (null if n is 0)."""

    def run(batches):
        rng = np.random.default_rng(11)
        flip, factor = rng.integers(0, 2**64, coordinates, np.uint64), rng.integers(0, 2**64, coordinates, np.uint64) | np.uint64(1)
        hashes = shared.worker_memory("word hashes").setdefault(0, WordHashes())
        for batch in shared.slices(batches, 1000, 8 << 20):
            sets = [shingles(t, size, hashes) for t in batch.column("text").to_pylist()]
            n = np.array([len(s) for s in sets])
            full = np.flatnonzero(n)
            sig, keys = np.zeros((batch.num_rows, coordinates), np.uint32), np.zeros((2, batch.num_rows), np.uint64)
            if len(full):
                every, start = np.concatenate([sets[i] for i in full]), np.r_[0, np.cumsum(n[full])[:-1]]
                for j in range(coordinates):
                    sig[full, j] = np.minimum.reduceat((every ^ flip[j]) * factor[j], start) >> np.uint64(32)
                keys[0, full], keys[1, full] = np.add.reduceat(mix(every), start), np.add.reduceat(mix(every ^ flip[0]), start)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * coordinates, pa.int32()), pa.array(sig.reshape(-1).view(np.int32)))
            low = pa.array([x.tobytes() for x in sig.astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("k1"), batch.column("k2"), pa.array(n, pa.int64()), pa.array(signed(keys[0])), pa.array(signed(keys[1])), lists, low], ["doc_id", "k1", "k2", "n", "a", "b", "sig", "low"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, k1 bigint, k2 bigint, n bigint, a bigint, b bigint, sig array<int>, low binary")


def collided(lists: DataFrame, least: int) -> DataFrame:
    """(hub, cid) of the classes of lists(key, cid, weight, low) that collide at least `least` times with others of a list."""

    def run(batches):
        for _, (cids, weights, lows) in groups(batches, ["key"], ["cid", "weight", "low"]):
            low = np.frombuffer(b"".join(lows), np.uint8).reshape(len(cids), -1)
            union = Union(len(cids))
            for i in range(len(cids) - 1):
                for j in np.flatnonzero((low[i] == low[i + 1 :]).sum(1) >= least):
                    union.join(i, i + 1 + int(j))
            joined: dict[int, list[int]] = {}
            for i in range(len(cids)):
                joined.setdefault(union.find(i), []).append(i)
            out = []
            for own in joined.values():
                if len(own) > 1:
                    hub = cids[max(own, key=lambda i: (weights[i], cids[i]))]
                    out += [(hub, cids[i]) for i in own]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["hub", "cid"])

    return lists.repartition("key").sortWithinPartitions("key").mapInArrow(run, "hub bigint, cid bigint")


def families(classes: DataFrame, least: int = MATCHES, cell: int = CELL) -> DataFrame:
    """(hub, cid, n) of all candidates among classes(cid, n, sig, low), a hub with itself included."""
    posted = classes.select("cid", F.posexplode("sig").alias("j", "v")).select("cid", (F.shiftleft(F.col("j").cast("bigint"), 32) + F.col("v").cast("bigint")).alias("key"))
    often = posted.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1")
    own = posted.join(often, "key").groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("shared"))
    own = own.filter(F.size("shared") >= least)
    weight = F.aggregate("shared", F.lit(0).cast("bigint"), lambda a, x: a + x["df"])
    own = own.select("cid", weight.alias("weight"), F.slice("shared", F.lit(1), F.size("shared") - least + 1).alias("shared")).join(classes.select("cid", "low").hint("merge"), "cid")
    prefix = shared.materialise(own.select("cid", "weight", "low", F.explode("shared").alias("x")).select("cid", "weight", "low", "x.key"), "prefix")
    hubs = prefix.groupBy("key").agg(F.max(F.struct("weight", "cid")).alias("hub"), F.count("*").alias("size")).filter("size > 1")
    lists = prefix.join(hubs.select("key", F.col("hub.cid").alias("hub"), "size"), "key")
    small = collided(lists.filter(F.col("size") <= cell).select("key", "cid", "weight", "low"), least)
    found = small.unionByName(lists.filter(F.col("size") > cell).select("hub", "cid")).distinct()
    found = shared.materialise(found.join(classes.select("cid", "n").hint("merge"), "cid"), "families")
    shared.drop(prefix)
    return found


def full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(cid, set) of wanted(cid, k1, k2): the sorted shingle hashes as bytes."""

    def run(batches):
        hashes = shared.worker_memory("word hashes").setdefault(0, WordHashes())
        for batch in shared.slices(batches, 1000, 8 << 20):
            sets = [shingles(t, size, hashes).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array(sets, pa.binary())], ["cid", "set"])

    # few texts are wanted, so most stay where they are; joins of growing sides are by shuffle at every size
    some = shared.likely(docs.select("k1", "k2", "text"), "k1", wanted.select(F.col("k1").alias("key")))
    found = some.join(wanted.hint("merge"), ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    return found.select("cid", "text").mapInArrow(run, "cid bigint, set binary")


def similar(common, n, m, percent: int = SIMILAR):
    return 100 * common >= percent * (n + m - common)


def links_within(outside: list[int], sets: list[np.ndarray], percent: int):
    """(outside member, member) pairs that are similar, for each of outside against all sets."""
    n = np.array([len(s) for s in sets])
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), n)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    for y in outside:
        lo, hi = np.searchsorted(every, sets[y], "left"), np.searchsorted(every, sets[y], "right")
        size = hi - lo
        at = np.repeat(lo - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        common = np.bincount(owner[at], minlength=len(sets))
        for x in np.flatnonzero(similar(common, n[y], n, percent)):
            if x != y:
                yield y, int(x)


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[x] = y
        return x != y


def groups(batches, keys: list[str], columns: list[str]):
    """Rows of sorted batches, cut where the keys change: (key, columns as lists)."""
    key, held = None, None
    for batch in batches:
        data = [batch.column(c).to_pylist() for c in (*keys, *columns)]
        for row in zip(*data):
            if row[: len(keys)] != key:
                if held:
                    yield key, held
                key, held = row[: len(keys)], [[] for _ in columns]
            for c, v in zip(held, row[len(keys) :]):
                c.append(v)
    if held:
        yield key, held


def star_links(cells: DataFrame, percent: int) -> DataFrame:
    """From cells (hub, block, blocks, cid, set): links (x, y), and rows (x, null) for members outside in a family of several blocks."""

    def run(batches):
        for b, ((hub, _, blocks), (cids, data)) in enumerate(groups(batches, ["hub", "block", "blocks"], ["cid", "set"])):
            sets = [np.frombuffer(d, np.uint64) for d in data]
            center, union, out = cids.index(hub), Union(len(cids)), []
            outside = []
            for i, s in enumerate(sets):
                if i != center and cids[i] != hub:
                    at = np.minimum(np.searchsorted(sets[center], s), len(sets[center]) - 1)
                    if similar(int((sets[center][at] == s).sum()), len(s), len(sets[center]), percent):
                        union.join(i, center)
                        out.append((hub, cids[i], hub))
                    else:
                        outside.append(i)
            if blocks > 1:
                out += [(hub, cids[i], None) for i in outside]
            elif outside and len(cids) > 2:
                out += [(hub, cids[y], cids[x]) for y, x in links_within(outside, sets, percent) if union.join(y, x)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["hub", "x", "y"])

    return cells.repartition("hub", "block").sortWithinPartitions("hub", "block").mapInArrow(run, "hub bigint, x bigint, y bigint")


def outside_links(cells: DataFrame, percent: int) -> DataFrame:
    """From cells (hub, ob, mb, outer, cid, set): links (x, y) between the outer and all members of each cell."""

    def run(batches):
        for _, (outer, cids, data) in groups(batches, ["hub", "ob", "mb"], ["outer", "cid", "set"]):
            sets, union = [np.frombuffer(d, np.uint64) for d in data], Union(len(cids))
            outside = [i for i, o in enumerate(outer) if o]
            out = [(cids[y], cids[x]) for y, x in links_within(outside, sets, percent) if cids[x] != cids[y] and union.join(y, x)] if outside else []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["x", "y"])

    return cells.repartition("hub", "ob", "mb").sortWithinPartitions("hub", "ob", "mb").mapInArrow(run, "x bigint, y bigint")


def confirmed(members: DataFrame, sets: DataFrame, percent: int = SIMILAR, cell: int = CELL) -> DataFrame:
    """Links (x, y) that join all similar classes of each family of members(hub, cid, n), n shingles each, given sets(cid, set)."""
    cells = F.ceil(F.greatest(F.count("*") / cell, F.sum("n") / CELL_SHINGLES))
    size = members.groupBy("hub").agg(cells.alias("blocks"))
    placed = members.join(size, "hub").withColumn("block", F.when(F.col("hub") == F.col("cid"), F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("cid"), "blocks"))))
    placed = placed.withColumn("block", F.explode("block"))
    found = shared.materialise(star_links(placed.join(sets.hint("merge"), "cid").select("hub", "block", "blocks", "cid", "set"), percent), "star")
    links = found.filter("y IS NOT NULL").select("x", "y")
    outer = found.filter("y IS NULL").select("hub", F.col("x").alias("cid"))
    if outer.isEmpty():
        return found.select("x", "y")
    outer = outer.join(members, ["hub", "cid"])
    parts = outer.groupBy("hub").agg(cells.alias("parts")).join(size, "hub")
    inner = members.join(parts, "hub").withColumn("mb", F.pmod(F.xxhash64("cid"), "blocks")).withColumn("ob", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    outer = outer.join(parts, "hub").withColumn("ob", F.pmod(F.xxhash64("cid"), "parts")).withColumn("mb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    both = inner.select("hub", "ob", "mb", F.lit(False).alias("outer"), "cid").unionByName(outer.select("hub", "ob", "mb", F.lit(True).alias("outer"), "cid"))
    more = outside_links(both.join(sets.hint("merge"), "cid").select("hub", "ob", "mb", "outer", "cid", "set"), percent)
    every = shared.materialise(links.unionByName(more), "links")
    shared.drop(found)
    return every


def components(links: DataFrame) -> DataFrame:
    """(v, label) of every class in links(x, y): label is the smallest class id that it reaches."""
    edges = shared.materialise(links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    labels = shared.materialise(edges.groupBy(F.col("x").alias("v")).agg(F.least(F.col("x"), F.min("y")).alias("label")), "labels")
    for _ in range(MAX_ROUNDS):
        near = edges.join(labels.select(F.col("v").alias("y"), "label"), "y").groupBy(F.col("x").alias("v")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "v").select("v", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("v").alias("low"), F.col("label").alias("lowest"))
        old, moved = labels, shared.materialise(lower.join(jump, "low", "left").select("v", F.least("low", F.coalesce("lowest", "low")).alias("label"), (F.least("low", F.coalesce("lowest", "low")) < F.col("label")).alias("moved")), "labels")
        shared.drop(old)
        labels = moved
        if moved.filter("moved").isEmpty():
            shared.drop(edges)
            return labels.select("v", "label")
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def near_duplicates(docs: DataFrame, size: int = WORDS, percent: int = SIMILAR) -> DataFrame:
    """doc_id, k1, k2, n_shingles, component_id and kept of every row of docs(doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("k2"), text).alias("k2"))
    signed = shared.materialise(signatures(docs, size), "signatures")
    sets = signed.filter("n > 0").groupBy("a", "b", "n").agg(F.min("doc_id").alias("rep"), F.min(F.struct("k1", "k2")).alias("k"), F.first("sig").alias("sig"), F.first("low").alias("low"))
    classes = shared.materialise(sets.select(F.col("a").alias("cid"), "n", "rep", "k.k1", "k.k2", "sig", "low"), "classes")
    members = families(classes)
    wanted = classes.join(members.select("cid").distinct(), "cid").select("cid", "k1", "k2")
    held = shared.materialise(full_sets(docs, wanted, size), "sets")
    found = components(confirmed(members, held, percent)).withColumnRenamed("v", "cid")
    shared.drop(members, held)
    ids = classes.select("cid", "rep").join(found, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    lowest = ids.groupBy("label").agg(F.min("rep").alias("component_id"))
    by_set = ids.join(lowest, "label").select(F.col("cid").alias("a"), "component_id")
    whole = signed.select("doc_id", "k1", "k2", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("a")).alias("a"))
    out = whole.join(by_set, "a", "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "k1", "k2", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(shared.table(spark, sf_dir, "documents"), QUERY_WORDS).drop("k1", "k2")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of docs(doc_id, text, ...) for each group of near-duplicates, all columns as they are.

    Rows that repeat the kept document's doc_id and text stay once; rows without text all stay.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = near_duplicates(docs, **options).filter("kept").select(F.col("doc_id").alias("_id"), F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), (F.col("n_shingles") > 0).alias("_has"))
    kept = shared.materialise(kept.distinct(), "kept")
    own = shared.as_row(docs, __id=F.col("doc_id"), __k1=F.xxhash64(text), __k2=F.xxhash64(F.lit("k2"), text))
    joined = own.join(kept, F.col("__id").eqNullSafe(F.col("_id")) & (F.col("__k1") == F.col("_k1")) & (F.col("__k2") == F.col("_k2")))
    once = joined.filter("_has").dropDuplicates(["__id", "__k1", "__k2"])
    return shared.from_row(once.unionByName(joined.filter(~F.col("_has"))), docs)
