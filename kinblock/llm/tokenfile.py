"""Token-ID files: Parquet list columns that allow selective reads.

Documents are dealt by ranges of doc_id, sorted, encoded, and written with
dictionary-coded ids (delta-coded where a chunk's dictionary grows too large),
fixed row groups and pages of few rows with page indexes, so that a reader of
a doc_id range or of the metadata alone touches only those pages.

Rows: doc_id, ids (list of int), n_tokens, part and part_start (ids of all
documents before it in its part).  Parts ascend by doc_id and a hash of the
text, so that one doc_id with very many rows is not one task.

Defined results: a null or empty text gives the end id alone; very long texts
are encoded whole, slice by slice; repeated doc_ids stay, in the order of a
hash of their texts, then of the texts (ties are equal rows); rows with a null
doc_id come first; an empty table gives an empty file; other columns are not
written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import fresh_path
from .common import map_arrow
from .tokens import Ranges, column_bytes, library_encoder, library_ranges

MODEL = "byte_bpe_50k.json"
END_ID = 0
#: Parquet settings of the file format.
FORMAT = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "1000",
}


def list_array(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))


def with_end(ids: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """``end`` after the ids of each document."""
    return np.insert(ids, np.cumsum(sizes), end).astype(np.int32, copy=False), sizes + 1


def crc_of_lists(column: pa.Array) -> list[int]:
    """Unsigned crc32 of each list as little-endian unsigned 32-bit integers."""
    offsets = column.offsets.to_numpy()
    data = memoryview(np.ascontiguousarray(column.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
    return [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets.tolist(), offsets[1:].tolist())]


def _encoded(model: str, end: int, ranges: Ranges):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before, encoder = TaskContext.get().partitionId(), 0, library_encoder(model, ranges)
        for batch in batches:
            done = 0
            for n, ids, sizes in encoder.texts(column_bytes(batch.column(1))):
                ids, sizes = with_end(ids, sizes, end)
                starts = before + np.cumsum(sizes) - sizes
                before += len(ids)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(done, n), list_array(ids, sizes), pa.array(sizes, pa.int64()), pa.array([part] * n, pa.int32()), pa.array(starts, pa.int64())],
                    names=["doc_id", "ids", "n_tokens", "part", "part_start"],
                )
                done += n

    return run


def write(docs: DataFrame, path: str, model: str = MODEL, end_id: int = END_ID) -> None:
    """Write the token file of ``docs`` (doc_id, text) at ``path``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    # dealt and sorted as texts: encoding comes after the sampling pass of the range exchange
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("hash")).repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text")
    shape = f"doc_id {kind}, ids array<int>, n_tokens long, part int, part_start long"
    map_arrow(rows.select("doc_id", "text"), _encoded(model, end_id, library_ranges(model)), shape).write.options(**FORMAT).parquet(path)


def offsets(rows: DataFrame) -> DataFrame:
    """(part, offset): ids before each part of the token file ``rows``."""
    totals = rows.groupBy("part").agg(F.max(F.col("part_start") + F.col("n_tokens")).alias("n"))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    return totals.select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("offset"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a token file with ``start``, the ids of all documents before each."""
    rows = spark.read.parquet(path)
    return rows.join(offsets(rows), "part").withColumn("start", F.col("offset") + F.col("part_start")).drop("offset")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column("ids")
        out = [b.column("doc_id"), b.column("part"), b.column("part_start"), pa.array(ids.value_lengths(), pa.int64()), pa.array(crc_of_lists(ids), pa.int64())]
        yield pa.RecordBatch.from_arrays(out, names=["doc_id", "part", "part_start", "n_tokens", "ids_crc32"])


def op3(docs: DataFrame) -> DataFrame:
    """Write the file of ``docs``, read it back, and digest the ids that were read."""
    spark = docs.sparkSession
    path = fresh_path(spark, "token-ids")
    write(docs, path)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = spark.read.parquet(path).select("doc_id", "ids", "part", "part_start")
    digests = map_arrow(rows, _digests, f"doc_id {kind}, part int, part_start long, n_tokens long, ids_crc32 long")
    return digests.join(offsets(spark.read.parquet(path)), "part").select("doc_id", (F.col("offset") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")
