"""What the operators share: tables, the shared working folder, and batches of texts."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and Python classes of the white space that separates words.
SPACES = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: A-Z in lower case and nothing else changed.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: As ASCII_LOWER; every ASCII byte that is neither a letter nor a digit becomes a space.
ALNUM_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders that materialise() has written, for clean().
WRITTEN: list[str] = []


def work_path(spark: SparkSession, label: str) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share; a temporary one only where that is unset and all run here."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='veristrata-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/veristrata/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, and gives the planner true sizes."""
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.parquet(path)
    WRITTEN.append(path)
    # shuffle files of jobs that are done go only when the driver's collector finds that nothing uses them
    spark._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of materialise() that nothing lazy reads any more."""
    for t in tables:
        clean(t.sparkSession, [t._written])


def clean(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete working tables (all that were written) once no result that reads them is wanted any more."""
    for path in list(WRITTEN) if paths is None else paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        WRITTEN.remove(path)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def text_key(column: Column) -> list[Column]:
    """A 128-bit key of a text: two hashes of it, as bigints k1 and k2."""
    md5 = F.md5(column)
    return [F.conv(F.substring(md5, 1, 16), 16, -10).cast("bigint").alias("k1"), F.conv(F.substring(md5, 17, 16), 16, -10).cast("bigint").alias("k2")]


def slices(batches, size: int = 2000, most: int = 32 << 20):
    """Arrow batches cut so that none has over `size` rows or, unless one row alone does, over about `most` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, min(size, int(size if batch.nbytes <= most else batch.num_rows * most / batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000):
    """Within, rows go to Python workers in Arrow batches of at most so many, which bounds what both sides hold."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def give_back() -> None:
    """Return memory that a worker's libraries hold free to the system."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


def worker_memory(name: str) -> dict:
    """A dict that lives on in the Python worker over its tasks, until one of another name is asked for.

    It must only save time: results may not depend on it.
    """
    import sys

    held = sys.__dict__.setdefault("_veristrata_memory", {})
    if name not in held:
        held.clear()
        held[name] = {}
    return held[name]


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: The column that holds a whole row while an operator works beside it, so that no name of the row can clash.
ROW = "__row"


def as_row(df: DataFrame, **columns: Column) -> DataFrame:
    """df's rows in the column ROW, with further columns made from df's."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(ROW), *(v.alias(k) for k, v in columns.items()))


def from_row(df: DataFrame, like: DataFrame, **changed: Column) -> DataFrame:
    """The rows held in ROW with like's columns, some of them changed."""
    return df.select(*((changed[c] if c in changed else F.col(ROW).getField(c)).alias(c) for c in like.columns))


#: Bits of a table of keys.
BITS = 1 << 26


def bit_words(keys: DataFrame, bits: int = BITS) -> DataFrame:
    """(w, v): the words of a table in which the bit of each of keys(key) is set; bits / 64 rows at most."""
    bit = F.col("key").bitwiseAND(F.lit(bits - 1))
    words = keys.select(F.shiftright(bit, 6).alias("w"), F.expr("shiftleft(1L, cast(key & 63 AS int))").alias("v"))
    return words.groupBy("w").agg(F.expr("bit_or(v)").alias("v"))


def likely(rows: DataFrame, key: str, keys: DataFrame, bits: int = BITS) -> DataFrame:
    """The rows whose key is among keys(key), and some others: by a broadcast of at most bits / 64 words, without a shuffle of rows."""
    bit = F.col(key).bitwiseAND(F.lit(bits - 1))
    held = (F.shiftright(bit, 6) == F.col("w")) & (F.expr(f"shiftrightunsigned(v, cast(`{key}` & 63 AS int)) & 1") == 1)
    return rows.join(F.broadcast(bit_words(keys, bits)), held, "left_semi")


def bit_table(keys: DataFrame, bits: int = BITS) -> np.ndarray:
    """A table in which the bit of each of keys(key) is set. Words, not keys, reach the driver: bits / 64 at most."""
    out = np.zeros(bits // 64, np.int64)
    got = bit_words(keys, bits).toArrow()
    out[got.column("w").to_numpy()] = got.column("v").to_numpy()
    return out.view(np.uint8)


def in_table(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys (int64) have their bit set."""
    bit = keys.view(np.uint64) & np.uint64(BITS - 1)
    return (table[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
