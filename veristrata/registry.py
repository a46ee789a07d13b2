"""Where queries and their SQL oracles are registered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a (spark, sf_dir) query under a name, with its oracle."""

    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of files under which a scan may hold its rows in one row group, and so in one task.
SMALL = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """df for heavy work on each row: a scan of a few small files is dealt to all cores, a larger one stays as it is."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    if int(str(stats.sizeInBytes())) > SMALL:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def spelled(rows: list[tuple], names: str) -> str:
    """Literal rows as a SQL table expression, for cases that the driver's tables do not hold."""

    def value(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(map(value, v)) + "]"
        return f"{v!r}::DOUBLE" if isinstance(v, float) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    return f"(VALUES {', '.join('(' + ', '.join(map(value, r)) + ')' for r in rows)}) AS t({names})"
