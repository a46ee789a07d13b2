"""Packing of documents into sequences by bin completion.

Documents become token pieces of at most `capacity`; the packing itself needs their lengths only, so the driver
solves it on a histogram of at most `capacity` counts, however many pieces there are. Branch and bound: around the
largest remaining piece, enumerate the undominated fillings of the room beside it, least waste first, and apply one as
often as the counts allow, then less often; cut a branch whose waste, or whose bound for what is left, cannot beat the
incumbent, which at first is best-fit decreasing. The search ends when the incumbent meets the lower bound, when every
branch is cut (either proves it smallest), or after `nodes` steps. The chosen fillings then go back to the pieces by
their number within their length.

Null and empty texts are pieces of one end id. Repeated rows are packed once each. An empty table packs nothing.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veristrata.llm import encoding, shared

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 2048
END_ID = 0
#: Steps of the search before the incumbent is returned.
NODES = 50_000
#: Parts in which the pieces of one length are numbered.
PARTS = 1024


def best_fit(counts: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: (lengths, how many sequences)."""
    rooms: list[list[list]] = [[] for _ in range(capacity + 1)]
    for size in range(capacity, 0, -1):
        left = counts[size]
        room = size
        while left and room < capacity:
            if rooms[room]:
                group = rooms[room][-1]
                n = min(left, group[1])
                group[1] -= n
                if not group[1]:
                    rooms[room].pop()
                rooms[room - size].append([(*group[0], size), n])
                left -= n
                room = max(size, min(room, room - size)) if room - size >= size else room
            else:
                room += 1
        if left:
            per = capacity // size
            whole, rest = divmod(left, per)
            if whole:
                rooms[capacity - per * size].append([(size,) * per, whole])
            if rest:
                rooms[capacity - rest * size].append([(size,) * rest, 1])
    return [(tuple(p), n) for groups in rooms for p, n in groups if n]


def lower_bound(counts: list[int], capacity: int) -> int:
    """Sequences that any packing needs: pieces over half are apart, and those of at least some length fill only their rooms."""
    n = np.array(counts, np.int64)
    pieces, tokens = np.r_[0, np.cumsum(n)], np.r_[0, np.cumsum(n * np.arange(capacity + 1))]
    k = np.arange(capacity // 2 + 1)
    half = capacity // 2 + 1
    alone = pieces[-1] - pieces[capacity - k + 1]  # no piece of length k or more fits beside them
    wide = pieces[capacity - k + 1] - pieces[half]
    room = wide * capacity - (tokens[capacity - k + 1] - tokens[half])
    rest = tokens[half] - tokens[k] - room
    return int((alone + wide + np.maximum(0, -(-rest // capacity))).max())


def spread(sums: int, lo: int, hi: int) -> int:
    """The bit set of all x + lo to x + hi, for the x in sums."""
    out, done = sums << lo if hi >= lo else 0, 1
    while done < hi - lo + 1:
        step = min(done, hi - lo + 1 - done)
        out |= out << step
        done += step
    return out


def dominated(filling: tuple[tuple[int, int], ...], waste: int, left: list[int], present: int) -> bool:
    """Whether a piece that is left could stand in place of some of a filling's pieces, being no shorter than they are
    together, and longer than them or fewer. left: counts beside the filling; present: bit x is set where left[x] > 0."""
    one, more = 1, 0  # sums of at most one of the pieces, and of two or more
    for size, n in filling:
        if left[size] == n:
            present &= ~(1 << size)
        for _ in range(n):
            more |= more << size | (one & ~1) << size
            one |= 1 << size
    return bool((spread(one, 1, waste) | spread(more, 0, waste)) & present)


def fillings(left: list[int], room: int, most: int, steps: list[int]):
    """(waste, ((length, times), ...)) of the undominated fillings of a room that waste up to `most`, least waste first,
    made one by one; each counts down steps[0]."""
    sizes = [size for size in range(room, 0, -1) if left[size]]
    present = sum(1 << size for size in sizes)
    # sums that sizes[k:] can make
    reach, mask = [1], (1 << room + 1) - 1
    for size in reversed(sizes):
        sums, n, step = reach[-1], min(left[size], room // size), 1
        while n > 0:
            step = min(step, n)
            sums |= sums << size * step & mask
            n, step = n - step, 2 * step
        reach.append(sums)
    reach.reverse()
    chosen: list[tuple[int, int]] = []

    def exact(k: int, rest: int):
        if not rest:
            yield tuple(chosen)
            return
        while reach[k] >> rest & 1 and steps[0] > 0:
            size = sizes[k]
            for n in range(min(left[size], rest // size), 0, -1):
                if reach[k + 1] >> rest - n * size & 1 and steps[0] > 0:
                    steps[0] -= 1
                    chosen.append((size, n))
                    yield from exact(k + 1, rest - n * size)
                    chosen.pop()
            k += 1

    for waste in range(min(most, room) + 1):
        if reach[0] >> room - waste & 1:
            for filling in exact(0, room - waste):
                if not dominated(filling, waste, left, present):
                    yield waste, filling


def complete_bins(counts: list[int], capacity: int = CAPACITY, nodes: int = NODES) -> tuple[list[tuple[tuple[int, ...], int]], bool]:
    """Fillings (lengths, how many sequences) for counts[length] pieces of each length, and whether that is proven to be fewest."""
    total = sum(size * n for size, n in enumerate(counts))
    bound = lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    fewest = sum(n for _, n in best)
    left, steps = list(counts), [nodes]
    bins = waste = 0
    path: list[tuple[tuple[tuple[int, int], ...], int, int]] = []

    def options():
        """(filling, times, waste) for the largest piece that is left."""
        own = list(left)
        size = next(size for size in range(capacity, 0, -1) if own[size])
        own[size] -= 1
        for lost, beside in fillings(own, capacity - size, (fewest - 1) * capacity - total - waste, steps):
            filling = ((size, 1 + beside[0][1]), *beside[1:]) if beside and beside[0][0] == size else ((size, 1), *beside)
            for times in range(min(left[x] // n for x, n in filling), 0, -1):
                yield filling, times, lost

    def apply(filling, times: int, lost: int, sign: int) -> None:
        nonlocal bins, waste
        bins, waste = bins + sign * times, waste + sign * times * lost
        for x, n in filling:
            left[x] -= sign * n * times

    stack = [options()] if fewest > bound else []
    while stack and steps[0] > 0 and fewest > bound:
        option = next(stack[-1], None)
        if option is None:
            if steps[0] <= 0:
                break
            stack.pop()
            if path:
                apply(*path.pop(), -1)
            continue
        steps[0] -= 1
        filling, times, lost = option
        if waste + lost * times > (fewest - 1) * capacity - total:
            continue
        apply(*option, 1)
        path.append(option)
        if bins < fewest and not any(left):
            fewest, best = bins, [(tuple(x for x, n in f for _ in range(n)), t) for f, t, _ in path]
        if any(left) and bins + lower_bound(left, capacity) < fewest:
            stack.append(options())
        else:
            apply(*path.pop(), -1)
    return best, fewest <= bound or not stack


def cut_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, little-endian uint32) of the pieces of docs(doc_id, text)."""

    def run(batches):
        import public_tokenizers

        encode = encoding.encoder(path or public_tokenizers.path(VOCABULARY), False, end_id)
        for b in shared.slices(batches, 2000, 8 << 20):
            ids, offsets = encode(b.column("text"))
            # each document's pieces, one after the other
            pieces = -(-np.diff(offsets) // capacity)
            doc = np.repeat(np.arange(len(pieces)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            lo = offsets[doc] + start
            hi = np.minimum(lo + capacity, offsets[doc + 1])
            data = memoryview(ids.tobytes())
            parts = [data[a:z] for a, z in zip((4 * lo).tolist(), (4 * hi).tolist())]
            columns = [b.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(hi - lo), pa.array(map(zlib.crc32, parts), pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(map(bytes, parts), pa.binary())] * with_ids, names[: 5 + with_ids])
        shared.give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", shared.text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """pieces(doc_id, piece, length, ...) with sequence_id and offset.

    pieces is read several times: give it materialised. What the driver and the tasks hold is bounded by capacity
    and nodes, not by the number of pieces.
    """
    sizes = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    counts = [sizes.get(i, 0) for i in range(capacity + 1)]
    # rows of a length that stand in one kind of filling: first number, per sequence, first sequence, offset
    rows, taken, sequence = [], [0] * (capacity + 1), 0
    for lengths, times in complete_bins(counts, capacity, nodes)[0]:
        offset = 0
        for size in sorted(set(lengths), reverse=True):
            per = lengths.count(size)
            rows.append((size, taken[size], per, sequence, offset))
            taken[size] += per * times
            offset += per * size
        sequence += times
    rows.sort()
    places = np.array(rows, np.int64).reshape(-1, 5)

    own_columns = pieces.columns
    part, own, ahead, number = (shared.free_name(pieces, c) for c in ("part", "own", "before", "number"))
    numbered = pieces.withColumn(part, F.pmod(F.xxhash64("doc_id", "piece"), F.lit(PARTS)))
    # of each length at most PARTS rows
    before = numbered.groupBy("length", part).agg(F.count("*").alias("n"))
    before = before.select("length", part, (F.sum("n").over(Window.partitionBy("length").orderBy(part)) - F.col("n")).alias(ahead))
    rank = F.row_number().over(Window.partitionBy("length", part).orderBy("doc_id", "piece", "ids_crc32"))
    numbered = numbered.withColumn(own, rank).join(before, ["length", part]).select(*own_columns, (F.col(ahead) + F.col(own) - 1).alias(number))

    def run(batches):
        key = places[:, 0] << 44 | places[:, 1]
        for b in batches:
            if b.num_rows:
                size, at = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", number))
                row = places[np.searchsorted(key, size << 44 | at, "right") - 1]
                index = at - row[:, 1]
                found = {"sequence_id": row[:, 3] + index // row[:, 2], "offset": row[:, 4] + index % row[:, 2] * size}
                columns = [b.column(c) for c in own_columns] + [pa.array(v) for v in found.values()]
                yield pa.RecordBatch.from_arrays(columns, [*own_columns, *found])

    return numbered.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    with shared.small_batches(docs.sparkSession):
        pieces = shared.materialise(cut_pieces(docs, path, capacity, end_id, with_ids), "pieces")
    return pack_pieces(pieces, capacity)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(shared.table(spark, sf_dir, "documents"))
