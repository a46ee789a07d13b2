"""JSON lines, CSV and vectors (S-01, S-02, S-04 to S-07, S-14, S-19, N-09, L-07)."""

from __future__ import annotations

import ast
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S-01: rows of a schema; a blank line, bad JSON or a line that is no object is an error that names file and line text."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("__file"))
    trimmed = F.trim("value")
    row = F.from_json("value", schema, {"mode": "PERMISSIVE"})
    bad = (trimmed == "") | ~F.startswith(trimmed, F.lit("{")) | F.try_parse_json("value").isNull()
    told = F.raise_error(F.concat(F.lit("not a JSON object in "), F.col("__file"), F.lit(": "), F.substring("value", 1, 80)))
    return lines.select(F.when(bad, told).otherwise(row).alias("r")).select("r.*")


def write_jsonl(df: DataFrame, path: str) -> int:
    """S-02: one object a line, keys sorted, no spaces, in files that appear when the job commits; the number of rows."""
    df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns))), {"ignoreNullFields": "false"})).write.mode("overwrite").text(path)
    return count_lines(df.sparkSession, path)


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """S-04, S-06: header, quotes with line breaks inside, cells of any length; a .tsv file has tabs and no quotes."""
    tabs = path.endswith(".tsv")
    options = {"sep": "\t", "quote": ""} if tabs else {"quote": '"', "escape": '"', "multiLine": True}
    df = spark.read.options(header=True, maxCharsPerColumn=-1, **options).csv(path)
    return df.select(*(f"`{c}`" for c in columns)) if columns else df


@F.pandas_udf(StringType())
def _first(cells: pd.Series) -> pd.Series:
    def read(cell):
        try:
            value = ast.literal_eval(cell.strip())
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return cell.strip()
        while isinstance(value, (list, tuple)) and value:
            value = value[0]
        return None if value is None else str(value)

    return cells.map(read, na_action="ignore")


def scalar(cell: Column) -> Column:
    """S-05: the first scalar of a cell with a list or tuple literal, else the cell; empty cells are null."""
    literal = cell.rlike(r"^\s*[\[(]")
    return F.when(literal, _first(F.when(literal, cell))).when(cell != "", F.trim(cell))


def read_vectors(spark: SparkSession, path: str, dim: int, ids: list[str] | None = None, dtype: str = "<f2") -> DataFrame:
    """S-14: rows (at, embedding) of .npy matrices, read in tasks of one file each by memory map; ids must be as many as rows.

    path is a folder that every executor reaches as files.
    """
    listed = spark.read.format("binaryFile").load(f"{path}/*.npy").select("path", "length").orderBy("path")

    def run(batches):
        for b in batches:
            for name in b.column("path").to_pylist():
                x = np.load(re.sub(r"^file:/+", "/", name), mmap_mode="r")
                if x.shape[1] != dim:
                    raise ValueError(f"{name} has {x.shape[1]} columns, not {dim}")
                for at in range(0, len(x), 4096):
                    part = np.asarray(x[at : at + 4096], np.float32)
                    rows = pa.FixedSizeListArray.from_arrays(pa.array(part.reshape(-1)), dim).cast(pa.list_(pa.float32()))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(at, at + len(part))), rows], ["file", "at", "embedding"])

    out = listed.mapInArrow(run, "file string, at bigint, embedding array<float>")
    if ids is not None and (n := out.count()) != len(ids):
        raise ValueError(f"{len(ids)} ids for {n} vectors")
    return out


def splits_of(names: list[str]) -> dict[str, dict[str, str]]:
    """S-19: {dataset: {split: path}} of paths like .../dataset/split.jsonl."""
    out: dict[str, dict[str, str]] = {}
    for n in sorted(names):
        m = re.fullmatch(r"(?:.*/)?([^/]+)/(train|dev|test)\.jsonl", n)
        if m:
            out.setdefault(m[1], {})[m[2]] = n
    return out
