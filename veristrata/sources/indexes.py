"""Indexes with a manifest written last, point lookups, and vectors kept by text (S-15 to S-18, S-24, DQ-13)."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "MANIFEST.json"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # one small file


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, whole or not at all: written beside its place and renamed into it."""
    fs, p = _fs(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(path + ".new")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    fs.delete(p, False)
    if not fs.rename(beside, p):
        raise OSError(f"{path} could not be put in place")


def manifest(spark: SparkSession, path: str) -> dict:
    if not exists(spark, f"{path}/{MANIFEST}"):
        raise FileNotFoundError(f"{path} has no manifest: it was never finished")
    return json.loads(read_text(spark, f"{path}/{MANIFEST}"))


def write_index(parts: dict[str, DataFrame], path: str, settings: dict) -> dict:
    """S-16: each part as Parquet, then the manifest with their row counts and the settings. What is torn has no manifest."""
    spark = next(iter(parts.values())).sparkSession
    fs, p = _fs(spark, f"{path}/{MANIFEST}")
    fs.delete(p, False)
    for name, df in parts.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    rows = {name: spark.read.parquet(f"{path}/{name}").count() for name in parts}
    made = {"settings": settings, "rows": rows}
    write_text(spark, f"{path}/{MANIFEST}", json.dumps(made, sort_keys=True, ensure_ascii=False, indent=2) + "\n")
    return made


def read_index(spark: SparkSession, path: str, same: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """The parts of a finished index; DQ-13: their rows are as many as written, and the parts `same` as many as each other."""
    made = manifest(spark, path)
    parts = {name: spark.read.parquet(f"{path}/{name}") for name in made["rows"]}
    for name, n in made["rows"].items():
        if (found := parts[name].count()) != n:
            raise ValueError(f"{path}/{name} has {found} rows, its manifest says {n}")
    if len({made["rows"][s] for s in same}) > 1:
        raise ValueError(f"parts of different sizes: { {s: made['rows'][s] for s in same} }")
    return parts


def lookup(ranked: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """S-15: what docs hold of the ranked keys, read after the ranking; the keys are filters of the scan if they are few."""
    return ranked.join(docs, key, "left")


class VectorCache:
    """S-17: vectors(key, text_sha1, vector) of one encoder's settings; other settings are refused.

    modes: readwrite; readonly, which never writes; off, which knows nothing.
    """

    def __init__(self, spark: SparkSession, path: str, settings: dict, mode: str = "readwrite"):
        if mode not in ("readwrite", "readonly", "off"):
            raise ValueError(f"mode {mode!r}: readwrite, readonly or off")
        self.spark, self.path, self.settings, self.mode = spark, path, settings, mode
        if mode == "off":
            return
        if exists(spark, f"{path}/{MANIFEST}"):
            kept = json.loads(read_text(spark, f"{path}/{MANIFEST}"))
            if other := {k for k in settings.keys() | kept["settings"].keys() if settings.get(k) != kept["settings"].get(k)}:
                raise ValueError(f"{path} was made with other settings: {sorted(other)}")
        elif mode == "readwrite":
            write_text(spark, f"{path}/{MANIFEST}", json.dumps({"settings": settings, "version": 0}, sort_keys=True))

    def _version(self) -> int:
        return json.loads(read_text(self.spark, f"{self.path}/{MANIFEST}"))["version"] if exists(self.spark, f"{self.path}/{MANIFEST}") else 0

    def vectors(self) -> DataFrame:
        version = 0 if self.mode == "off" else self._version()
        if not version:
            return self.spark.createDataFrame([], "key string, text_sha1 string, vector array<float>")
        return self.spark.read.parquet(f"{self.path}/v{version}")

    def missing(self, docs: DataFrame) -> DataFrame:
        """docs(key, text) whose text has no vector: new ones and such that were changed."""
        return docs.withColumn("text_sha1", F.sha1("text")).join(self.vectors().select("key", "text_sha1"), ["key", "text_sha1"], "left_anti")

    def upsert(self, new: DataFrame) -> None:
        """new(key, text_sha1, vector) in place of what its keys had. The next version is whole before the manifest names it."""
        if self.mode != "readwrite":
            return
        version = self._version()
        kept = self.vectors().join(new.select("key"), "key", "left_anti")
        kept.unionByName(new.select("key", "text_sha1", "vector")).write.mode("overwrite").parquet(f"{self.path}/v{version + 1}")
        write_text(self.spark, f"{self.path}/{MANIFEST}", json.dumps({"settings": self.settings, "version": version + 1}, sort_keys=True))
        if version:
            fs, p = _fs(self.spark, f"{self.path}/v{version}")
            fs.delete(p, True)


class Registry:
    """S-18: names of datasets, the paths that each needs, and how it is read."""

    def __init__(self):
        self.known: dict[str, tuple[tuple[str, ...], Callable[..., DataFrame]]] = {}

    def add(self, name: str, *paths: str):
        def keep(load):
            self.known[name] = (paths, load)
            return load

        return keep

    def missing(self, spark: SparkSession, name: str) -> list[str]:
        return [p for p in self.known[name][0] if not exists(spark, p)]

    def available(self, spark: SparkSession) -> list[str]:
        return [n for n in sorted(self.known) if not self.missing(spark, n)]

    def load(self, spark: SparkSession, name: str) -> DataFrame:
        if name not in self.known:
            raise KeyError(f"no dataset {name}; known: {', '.join(sorted(self.known))}")
        if gone := self.missing(spark, name):
            raise FileNotFoundError(f"{name} needs {', '.join(gone)}")
        paths, load = self.known[name]
        return load(spark, *paths)


def sums(spark: SparkSession, path: str) -> DataFrame:
    """S-24, S-07: (path, length, sha256) of files, to hold against a list of what should have come."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def incomplete(spark: SparkSession, path: str, listed: DataFrame) -> DataFrame:
    """Names of listed(name, length, sha256) whose file is not there or not whole."""
    have = sums(spark, path).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "length", "sha256")
    return listed.join(have, ["name", "length", "sha256"], "left_anti").select("name")
