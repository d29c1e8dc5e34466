"""Shared helpers: staged tables, Arrow batches, size checks and hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import fresh_path

#: Rows up to which a side is broadcast, once they are counted.
BROADCAST_ROWS = 500_000
#: Bytes of an Arrow batch that goes to a Python worker.
ARROW_BYTES = 4 << 20
#: Rows of a file of a small staged table whose number of rows is known.
FILE_ROWS = 50_000
#: A key is hot if it holds over one in HOT of all rows; there are fewer than HOT such keys.
HOT = 500


def files(rows: int) -> int:
    """The files that a small table of about ``rows`` rows needs."""
    return -(-rows // FILE_ROWS) or 1


def staged(df: DataFrame, label: str, rows: int | None = None, **options: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts lineage, survives lost executors, and fixes the rows that later
    steps see even where the plan that made them is not deterministic.
    ``rows``: about how many there are, if they are small; then as many files are
    written as these need, whatever the number of partitions.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    out = df if rows is None else df.coalesce(files(rows))
    out.write.options(**{"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}, **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, run, shape) -> DataFrame:
    """``df.mapInArrow`` with batches of ARROW_BYTES at most (or one row).

    The session's own bound, if larger, is lowered for good: it is read when
    the plan runs, and its default lets a batch of long texts take 64 MiB on
    both sides of every Python worker.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(name)
    if not (now or "").rstrip("bB").isdigit() or int(now.rstrip("bB")) > ARROW_BYTES:
        conf.set(name, str(ARROW_BYTES))
    return df.mapInArrow(run, shape)


def sized(table: DataFrame) -> DataFrame | None:
    """``table`` (staged) to be broadcast if it has at most BROADCAST_ROWS rows, else as it is; None if it has none."""
    n = table.count()
    return None if not n else F.broadcast(table) if n <= BROADCAST_ROWS else table


def hot_keys(counts: DataFrame, key: str, total: int) -> list:
    """The keys of ``counts`` (``key``, n) that hold over one in HOT of ``total`` rows: fewer than HOT."""
    return [r[0] for r in counts.where(F.col("n") * HOT > total).select(key).collect()]


def lookup(rows: DataFrame, table: DataFrame, key: str, hot: list) -> DataFrame:
    """``rows`` joined with their ``key``'s one row of ``table``.

    The rows of a key meet in one task of a join; those of ``hot`` keys stay
    where they are, and these keys' rows of ``table`` are broadcast.
    """
    if not hot:
        return rows.join(table, key)
    among = F.col(key).isin(hot)
    return rows.where(among).join(F.broadcast(table.where(among)), key).unionByName(rows.where(~among).join(table.where(~among), key))


def barrier(df: DataFrame) -> DataFrame:
    """``df``, through whose computed columns no later filter is pushed.

    The optimizer replaces a filter's columns by their definitions to move it
    down; where those are array expressions over whole texts, they would be
    computed again in the filter, and per element inside a lambda.  A row
    number, which is not deterministic, holds the filter above the projection.
    """
    marked = df.withColumn("__row", F.monotonically_increasing_id())
    return marked.where("__row >= 0").drop("__row")
