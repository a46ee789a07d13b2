"""Token ids in files of directly addressable codes.

Every id is split into chunks of 8 bits, one level for each. Level 0 holds the lowest chunk of every token; a
continuation bitmap says which tokens have a further chunk on the next level, and a rank directory (set bits before
every 512th position) finds it in constant time. Any token or span of tokens is read without decoding what stands
before it. A file also holds the doc_ids and the offsets of its documents. Files are in ascending doc_id order
(nulls first, ties by the text's hash), each bounded in tokens, unless one document alone is longer.

Null and empty texts hold the end id only. Repeated rows are written once each. An empty table gives no files.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veristrata.llm import encoding, shared

VOCABULARY = "byte_bpe_50k.json"
#: Written after each document.
END_ID = 0
#: Tokens after which a file is closed.
FILE_TOKENS = 8_000_000
MAGIC = b"VSDAC001"
BLOCK = 512
#: Parts whose tokens are summed together, and most tasks that read files.
BLOCK_PARTS, MOST_TASKS = 1024, 10_000


def to_dac(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap, rank directory) of each level; the bitmap's bit i is set where a chunk goes on."""
    levels = []
    while True:
        more = ids > 255
        bits = np.packbits(more, bitorder="little")
        ranks = np.r_[np.uint64(0), np.cumsum(np.add.reduceat(more, np.arange(0, len(more), BLOCK)), dtype=np.uint64)] if len(more) else np.zeros(1, np.uint64)
        levels.append((ids.astype(np.uint8), bits, ranks))
        if not more.any():
            return levels
        ids = ids[more] >> np.uint32(8)


def rank(bits: np.ndarray, ranks: np.ndarray, at: int) -> int:
    """Set bits before position `at`, from the directory and one block."""
    block = at // BLOCK
    part = np.unpackbits(bits[block * BLOCK // 8 : (at + 7) // 8], bitorder="little")[: at - block * BLOCK]
    return int(ranks[block]) + int(part.sum())


def read_span(levels, lo: int, hi: int) -> np.ndarray:
    """The ids of tokens lo to hi (exclusive), by direct access."""
    chunks, bits, ranks = levels[0]
    out = chunks[lo:hi].astype(np.uint32)
    at = np.arange(hi - lo)
    for depth, (nxt, _, _) in enumerate(levels[1:], 1):
        more = np.unpackbits(bits[lo // 8 : (hi + 7) // 8], bitorder="little")[lo % 8 : lo % 8 + hi - lo].astype(bool)
        lo, n = rank(bits, ranks, lo), int(more.sum())
        at, hi = at[more], lo + n
        out[at] |= nxt[lo:hi].astype(np.uint32) << np.uint32(8 * depth)
        chunks, bits, ranks = levels[depth]
    return out


def read_token(levels, at: int) -> int:
    return int(read_span(levels, at, at + 1)[0])


def pack_file(doc_ids: list, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of one file: documents of so many ids each, which stand end to end in uint32 ids."""
    offsets = np.r_[0, np.cumsum(sizes)].astype("<u8")
    known = np.array([d is not None for d in doc_ids], np.uint8)
    parts = [known, np.array([d or 0 for d in doc_ids], "<i8"), offsets]
    levels = to_dac(ids)
    for level in levels:
        parts += level
    sizes = np.array([p.nbytes for p in parts], "<u8")
    return b"".join([MAGIC, np.array([len(doc_ids), len(levels)], "<u8").tobytes(), sizes.tobytes(), *(p.tobytes() for p in parts)])


class DacFile:
    """A file's documents and levels; arrays are views of its bytes."""

    def __init__(self, data):
        view = memoryview(data)
        if bytes(view[:8]) != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        n_docs, n_levels = (int(x) for x in np.frombuffer(view[8:24], "<u8"))
        n_parts = 3 + 3 * n_levels
        sizes = np.frombuffer(view[24 : 24 + 8 * n_parts], "<u8").astype(np.int64)
        ends = 24 + 8 * n_parts + np.cumsum(sizes)
        kinds = ["u1", "<i8", "<u8", *["u1", "u1", "<u8"] * n_levels]
        parts = [np.frombuffer(view[int(e - s) : int(e)], k) for s, e, k in zip(sizes, ends, kinds, strict=True)]
        self.doc_ids = [int(d) if k else None for k, d in zip(parts[0], parts[1], strict=True)]
        self.offsets = parts[2].astype(np.int64)
        self.levels = [tuple(parts[3 + 3 * i : 6 + 3 * i]) for i in range(n_levels)]
        assert len(self.doc_ids) == n_docs

    def document(self, n: int) -> np.ndarray:
        return read_span(self.levels, int(self.offsets[n]), int(self.offsets[n + 1]))


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write docs(doc_id, text) under folder, a URI that all executors reach; the table of files in order.

    A task writes each file under a name of its own attempt and then reports it, so what a lost or repeated task
    left behind is in no table and is never read.
    """

    def run(batches):
        import public_tokenizers
        from pyarrow import fs

        encode = encoding.encoder(path or public_tokenizers.path(VOCABULARY), True, end_id)
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        part = TaskContext.get().partitionId()
        doc_ids, sizes, ids, n, seq = [], [], [], 0, 0

        def flush():
            name = f"{base}/part-{part:06d}-{seq:05d}-{uuid.uuid4().hex}.dac"
            with store.open_output_stream(name) as out:
                out.write(pack_file(doc_ids, np.concatenate(sizes), np.concatenate(ids)))
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "file": name, "n_docs": len(doc_ids), "n_tokens": n}])

        for b in shared.slices(batches, 2000, 8 << 20):
            own, (found, offsets) = b.column("doc_id").to_pylist(), encode(b.column("text"))
            at = 0
            while at < len(own):
                # up to the document that fills the file
                to = min(len(own), int(np.searchsorted(offsets, offsets[at] + file_tokens - n)))
                doc_ids += own[at:to]
                sizes.append(np.diff(offsets[at : to + 1]))
                ids.append(found[offsets[at] : offsets[to]])
                n += int(offsets[to] - offsets[at])
                at = to
                if n >= file_tokens:
                    yield flush()
                    doc_ids, sizes, ids, n, seq = [], [], [], 0, seq + 1
        if n:
            yield flush()
        del doc_ids, sizes, ids
        shared.give_back()

    ranged = docs.select("doc_id", shared.text_or_empty().alias("text")).withColumn("tie", F.xxhash64("text"))
    ranged = ranged.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    with shared.small_batches(docs.sparkSession):
        return shared.materialise(ranged.mapInArrow(run, "part bigint, seq bigint, file string, n_docs bigint, n_tokens bigint"), "token-files")


def with_bases(files: DataFrame) -> DataFrame:
    """files(part, seq, n_tokens, ...) with `base`, the tokens of all files before: sums within parts, over parts within
    blocks, and over blocks, so that no task orders more than a part's files or BLOCK_PARTS parts; blocks are few."""
    block = F.floor(F.col("part") / BLOCK_PARTS).alias("block")
    parts = files.groupBy("part", block).agg(F.sum("n_tokens").alias("n"))
    blocks = parts.groupBy("block").agg(F.sum("n").alias("n"))
    before = lambda of, w: F.sum(of).over(w) - F.col(of)
    blocks = blocks.select("block", before("n", Window.orderBy("block")).alias("block_base"))
    parts = parts.select("part", "block", before("n", Window.partitionBy("block").orderBy("part")).alias("part_base"))
    bases = parts.join(blocks, "block").select("part", (F.col("part_base") + F.col("block_base")).alias("part_base"))
    own = before("n_tokens", Window.partitionBy("part").orderBy("seq"))
    return files.withColumn("own", own).join(bases, "part").withColumn("base", F.col("own") + F.col("part_base")).drop("own", "part_base")


def read_token_files(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from the files. The list of files stays a table."""

    def run(batches):
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        for b in batches:
            for name, base in zip(b.column("file").to_pylist(), b.column("base").to_pylist()):
                with store.open_input_file(name) as f:
                    file = DacFile(f.read_buffer())
                crc = [zlib.crc32(file.document(n).astype("<u4").tobytes()) for n in range(len(file.doc_ids))]
                yield pa.RecordBatch.from_arrays([pa.array(file.doc_ids, pa.int64()), pa.array(file.offsets[:-1] + base), pa.array(np.diff(file.offsets)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # a task for each file, as long as they are few
    listed = with_bases(files).select("file", "base").repartition(max(1, min(files.count(), MOST_TASKS)))
    return listed.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared.work_path(spark, "dac")
    files = write_token_files(shared.table(spark, sf_dir, "documents"), folder)
    return read_token_files(spark, folder, files)
