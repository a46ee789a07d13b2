"""Removal of repeated byte strings, by suffix arrays over the places where repeats can be.

Every window of LENGTH bytes has a key: the least hash of the SEED-byte strings in it, leftmost if there are several.
Equal windows have equal keys, at one distance. Runs of windows whose key stands at one place are segments; they are
counted by key, and a segment whose key stands alone is left at once.
Equal segments are dealt with by counting. Different segments of one key meet in a bucket: they are cut into pieces
where four bytes say so, pieces become symbols, and the suffix array of the symbols (Lyndon grouping, linear time)
gives the groups of suffixes that agree in so many pieces. Windows repeat if they begin with pieces of one group and
the bytes before the first and behind the last whole piece are equal too. A bucket of more than BUCKET different
segments is not gathered: its windows are hashed and counted in the cluster, which finds the same.

Before locations and bytes are shuffled, a bit table of fixed size takes away most keys that occur once; of more keys
than fill a quarter of it, a semi-join takes them away. Segments with more than HOT places are joined to them in SALTS
parts. Each document's repeated ranges are joined back to its text.

Null and empty texts have 0 bytes; an empty table gives an empty result. Rows that repeat a document count as further places. Texts of any length are
read, extra columns ignored, in parts of bounded size; windows on either side of a part's end are all seen once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.llm import shared
from veristrata.llm.near_dedup import groups, mix
from veristrata.llm.suffix_groups import neighbours, suffix_array

LENGTH, SEED = 200, 64
#: Bytes of text looked at together (under half of PLACE), and most segments of a bucket.
PART, PLACE, BUCKET = 1 << 20, 1 << 22, 20_000
#: Places of a segment over which it is dealt to several tasks, and to how many.
HOT, SALTS = 50_000, 64
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def parts(texts: list[bytes], length: int):
    """Groups of (row, offset, bytes) of about PART bytes; longer texts in parts that overlap by length - 1."""
    held, size = [], 0
    for row, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), PART):
            piece = t[at : at + PART + length - 1]
            if len(piece) >= length:
                held.append((row, at, piece))
                size += len(piece)
                if size >= PART:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def segments(held, length: int, seed: int):
    """Arrays of the segments of some parts: key, part, first byte and end in the part."""
    data = np.frombuffer(b"".join(p for _, _, p in held), np.uint8)
    sizes = np.array([len(p) for _, _, p in held])
    ends = np.cumsum(sizes)
    n = len(data)
    power = np.cumprod(np.r_[np.uint64(1), np.full(n, BASE)])
    sums = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], dtype=np.uint64)]
    h = (sums[seed:] - sums[:-seed]) * np.cumprod(np.r_[np.uint64(1), np.full(n - seed, INVERSE)])
    h = mix(h)
    del power, sums
    # the least hash (its upper bits) and, of equals, the leftmost place
    place = np.uint64(PLACE - 1)
    width, step, least = length - seed + 1, 1, (h & ~place) | np.arange(len(h), dtype=np.uint64)
    while step * 2 <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    count = n - length + 1
    least = np.minimum(least[:count], least[width - step : width - step + count])
    part = np.repeat(np.arange(len(held)), sizes)[:count]
    inside = np.arange(count) + length <= ends[part]
    new = np.r_[True, (least[1:] != least[:-1]) | (part[1:] != part[:-1])]
    starts = np.flatnonzero(new)
    stops = np.r_[starts[1:], count]
    good = inside[starts]
    starts, stops = starts[good], stops[good]
    own = part[starts]
    stops = np.minimum(stops, ends[own] - length + 1)  # windows of a part only
    first = ends[own] - sizes[own]
    key = h[(least[starts] & place).astype(np.int64)]
    return key.view(np.int64), own, starts - first, stops - 1 + length - first


def emit(docs: DataFrame, want: str, length: int, seed: int, table: np.ndarray | None = None) -> DataFrame:
    """Segments of docs(d, k1, text). want: "keys" (key), "places" (key, s, d, k1, lo, hi) or "bytes" (key, s, seg)."""
    fields = {"keys": "key bigint", "places": "key bigint, s bigint, d bigint, k1 bigint, lo bigint, hi bigint", "bytes": "key bigint, s bigint, seg binary"}[want]
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches):
        sent: set = set()
        for b in shared.slices(batches, 2000, 8 << 20):
            texts = [t.encode() for t in b.column("text").to_pylist()]
            d, k1 = b.column("d").to_pylist(), b.column("k1").to_pylist()
            for held in parts(texts, length):
                key, own, lo, hi = segments(held, length, seed)
                if table is not None:
                    keep = shared.in_table(table, key)
                    key, own, lo, hi = key[keep], own[keep], lo[keep], hi[keep]
                if not len(key):
                    continue
                if want == "keys":
                    yield pa.RecordBatch.from_arrays([pa.array(key)], names)
                    continue
                segs = [held[p][2][a:z] for p, a, z in zip(own.tolist(), lo.tolist(), hi.tolist(), strict=True)]
                s = np.array([xxhash.xxh3_64_intdigest(x) for x in segs], np.uint64).view(np.int64)
                if want == "places":
                    row, at = np.array([h[0] for h in held])[own], np.array([h[1] for h in held])[own]
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(s), pa.array([d[r] for r in row], pa.int64()), pa.array([k1[r] for r in row], pa.int64()), pa.array(lo + at), pa.array(hi + at)], names)
                    continue
                # of what this task has sent it sends no copy; the set is emptied now and then, which costs copies only
                sent = set() if len(sent) > 500_000 else sent
                fresh = [i for i, x in enumerate(zip(key.tolist(), s.tolist(), strict=True)) if not (x in sent or sent.add(x))]
                if fresh:
                    yield pa.RecordBatch.from_arrays([pa.array(key[fresh]), pa.array(s[fresh]), pa.array([segs[i] for i in fresh], pa.binary())], names)

    return docs.mapInArrow(run, fields)


def cuts(data: np.ndarray) -> np.ndarray:
    """Places before which a piece ends, by the four bytes before it; one in 24 or so."""
    x = np.zeros(len(data), np.uint32)
    for k in range(4):
        x[4:] = (x[4:] ^ data[3 - k : len(data) - 1 - k]) * np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    at = np.flatnonzero(x % np.uint32(24) == 0)
    return at[at >= 4]


def repeated_windows(segs: list[bytes], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """Per segment, runs (first, end) of window starts whose windows stand in the segments more than once."""
    pieces, symbols, where, borders = [], [], [], []
    for i, s in enumerate(segs):
        c = [x for x in cuts(np.frombuffer(s, np.uint8)).tolist() if x < len(s)]
        borders.append(c)
        pieces.append([s[a:b] for a, b in zip([0, *c], [*c, len(s)], strict=True)])
    ids = {p: len(segs) + r for r, p in enumerate(sorted({p for ps in pieces for p in ps}))}
    first = []
    for i, ps in enumerate(pieces):
        first.append(len(symbols))
        symbols += [ids[p] for p in ps]
        where += [i] * len(ps)
        symbols.append(i)  # an end of its own
        where.append(-1)
    order = suffix_array(symbols)
    common = np.array(neighbours(symbols, order)[: len(order) - 1], np.int64)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    rank = rank.tolist()
    # the group of each rank among suffixes that agree in m pieces: it changes where neighbours agree in fewer
    agreeing: dict[int, list[int]] = {}
    alone = np.maximum(np.r_[common, 0], np.r_[0, common]).tolist()
    counts: dict[tuple, int] = {}
    asked = []
    for i, s in enumerate(segs):
        # the cuts that lie in the window, with the four bytes that they come from
        c, at, last = borders[i], 0, -1
        for p in range(len(s) - length + 1):
            while at < len(c) and c[at] < p + 4:
                at += 1
            while last + 1 < len(c) and c[last + 1] <= p + length:
                last += 1
            whole = last - at
            if whole > 0:
                # piece at + 1 begins at cut at
                r = rank[first[i] + at + 1]
                if alone[r] < whole:
                    continue
                if whole not in agreeing:
                    agreeing[whole] = np.r_[0, np.cumsum(common < whole)].tolist()
                w = (whole, agreeing[whole][r], s[p : c[at]], s[c[last] : p + length])
            else:
                w = (s[p : p + length],)
            counts[w] = counts.get(w, 0) + 1
            asked.append((i, p, w))
    out: list[list] = [[] for _ in segs]
    for i, p, w in asked:
        if counts[w] > 1:
            if out[i] and out[i][-1][1] == p:
                out[i][-1][1] = p + 1
            else:
                out[i].append([p, p + 1])
    return [[tuple(r) for r in rs] for rs in out]


def solve(found: DataFrame, length: int) -> DataFrame:
    """(key, s, lo, hi): repeated byte ranges in the different segments of each bucket of found(key, s, seg)."""

    def run(batches):
        for (key,), (names, segs) in groups(batches, ["key"], ["s", "seg"]):
            unique = dict(zip(names, segs, strict=True))
            if len(unique) > 1:
                rows = [(key, s, lo, hi - 1 + length) for s, rs in zip(unique, repeated_windows(list(unique.values()), length), strict=True) for lo, hi in rs]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["key", "s", "lo", "hi"])

    return found.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key bigint, s bigint, lo bigint, hi bigint")


def solve_large(found: DataFrame, length: int) -> DataFrame:
    """As solve(), by counting hashed windows in the cluster: for buckets of any size."""

    def run(batches):
        for b in shared.slices(batches, 200):
            for key, s, seg in zip(*(b.column(c).to_pylist() for c in ("key", "s", "seg")), strict=True):
                n = len(seg) - length + 1
                w = [xxhash.xxh3_128_digest(seg[p : p + length]) for p in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([key] * n), pa.array([s] * n), pa.array(range(n)), pa.array(w, pa.binary())], ["key", "s", "lo", "w"])

    every = found.dropDuplicates(["key", "s"]).mapInArrow(run, "key bigint, s bigint, lo bigint, w binary")
    twice = every.groupBy("w").agg(F.count("*").alias("n")).filter("n > 1")
    return every.join(twice, "w").select("key", "s", "lo", (F.col("lo") + length).alias("hi"))


def salted(df: DataFrame, hot: DataFrame, salts: int, spread: bool) -> DataFrame:
    """df(key, ...) with a salt: 0, but of keys that share their bit with one of hot(key) a random one or, to spread rows, each."""
    table = shared.bit_table(hot)
    names = [*df.columns, "salt"]

    def run(batches):
        rng = np.random.default_rng(7)
        for b in batches:
            heavy = shared.in_table(table, b.column("key").to_numpy())
            if spread:
                times = np.where(heavy, salts, 1)
                row = np.repeat(np.arange(b.num_rows), times)
                b, salt = b.take(pa.array(row)), np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            else:
                salt = np.where(heavy, rng.integers(0, salts, b.num_rows), 0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(salt, pa.int64())], names)

    return df.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + ", salt bigint")


def having(docs: DataFrame, want: str, keys: DataFrame, length: int, seed: int, bits: int) -> DataFrame:
    """Segments whose key is in the table keys(key), and some others."""
    if keys.count() <= bits // 4:
        return emit(docs, want, length, seed, shared.bit_table(keys))
    return emit(docs, want, length, seed).join(keys, "key", "left_semi")


def repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, bucket: int = BUCKET, hot: int = HOT, bits: int = shared.BITS) -> DataFrame:
    """(d, k1, ranges): byte ranges (lo, hi) of docs(d, k1, text) covered by strings of `length` bytes that start elsewhere too."""
    again = emit(docs, "keys", length, seed).groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    again = shared.materialise(again, "repeated-keys")
    places = shared.materialise(having(docs, "places", again, length, seed, bits), "places")
    counts = shared.materialise(places.groupBy("key", "s").agg(F.count("*").alias("n"), F.max(F.col("hi") - F.col("lo")).alias("size")), "segments")
    several = counts.groupBy("key").agg(F.count("*").alias("different")).filter("different > 1")
    several = shared.materialise(several, "buckets")
    found = having(docs, "bytes", several.select("key"), length, seed, bits)
    large = several.filter(F.col("different") > bucket)
    whole = counts.filter("n > 1").select("key", "s", F.lit(0).cast("bigint").alias("lo"), F.col("size").alias("hi"))
    if large.isEmpty():
        partial = solve(found, length)
    else:
        found = shared.materialise(found, "bytes")
        partial = solve(found.join(large, "key", "left_anti"), length).unionByName(solve_large(found.join(large, "key", "left_semi"), length))
    # one row for each different segment, so that its places are not multiplied
    ranges = whole.unionByName(partial).groupBy("key", "s").agg(F.collect_set(F.struct("lo", "hi")).alias("found"))
    places = places.select("key", "s", "d", "k1", "lo")
    heavy = counts.filter(F.col("n") > hot).select("key").distinct()
    if heavy.isEmpty():
        at = places.join(ranges, ["key", "s"])
    else:
        heavy = shared.materialise(heavy, "hot")
        at = salted(places, heavy, SALTS, False).join(salted(ranges, heavy, SALTS, True), ["key", "s", "salt"])
    moved = F.transform("found", lambda r: F.struct((F.col("lo") + r["lo"]).alias("lo"), (F.col("lo") + r["hi"]).alias("hi")))
    return at.select("d", "k1", moved.alias("moved")).groupBy("d", "k1").agg(F.flatten(F.collect_list("moved")).alias("ranges"))


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.coalesce(F.col("doc_id"), F.lit(-(2**63))).cast("bigint").alias("d"), F.xxhash64(text).alias("k1"), text.alias("text"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, with_text: bool = False, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and spans, kept as bytes) of every row of docs(doc_id, text)."""
    docs = keyed(docs)
    joined = docs.join(repeats(docs.drop("doc_id"), length, seed, **options), ["d", "k1"], "left").select("doc_id", "text", "ranges")

    def run(batches):
        for b in shared.slices(batches):
            rows = []
            for doc_id, text, found in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "ranges")), strict=True):
                data, spans = text.encode(), []
                for lo, hi in sorted((r["lo"], r["hi"]) for r in found or ()):
                    if spans and lo <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], hi)
                    else:
                        spans.append([lo, hi])
                kept = b"".join(data[a:z] for a, z in zip([0, *(s[1] for s in spans)], [*(s[0] for s in spans), len(data)], strict=True))
                rows.append((doc_id, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"lo": a, "hi": z} for a, z in spans], kept)[: 7 if with_text else 5])
            kinds = [b.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])), pa.binary()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds)], names[: 7 if with_text else 5])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", spans array<struct<lo:bigint,hi:bigint>>, kept binary" * with_text)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(shared.table(spark, sf_dir, "documents"))
