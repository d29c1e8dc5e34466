"""Exact top-k search by inner product, in tiles.

Vectors become integers floor(scale * x), x as double.  They are packed into
shards, as bytes, once; the queries among them are picked from the shards and
packed into tiles.  Shards and tiles are dealt on a grid of about as many cells
as there are tasks, rows and columns chosen so that the fewest bytes are copied: every
query tile meets every shard in one cell, by one matrix product.  A meeting
keeps the k best of each query, and the lists are merged level by level over a
tree of grid columns.

Products run in double precision where the largest possible sum is below
2**53, hence exact, else in 64-bit integers, else in Python integers (a score
outside 64 bits is brought to the nearest of them).

Defined results: vectors that are null or hold a null or non-finite component
take no part, nor do rows with a null id; an empty vector scores 0; vectors of
different lengths are compared as if the shorter went on with zeros; a query
meets every row but its own, also others of the same vec_id; each of several
query rows with one vec_id has its own list; ties go to the smaller vec_id;
fewer than k other rows give a shorter list; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, staged

SHARD = 4096
TILE = 512
SCALE = 1024.0
FAN = 16
#: Grid cells a task slot.
CELLS = 4
LIMIT = 2**63 - 1


def _block(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows of ``sizes`` values each as a matrix, shorter rows filled with zeros."""
    dim = int(sizes.max(initial=0))
    if (sizes == dim).all():
        return values.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim))
    out[np.arange(dim)[None, :] < sizes[:, None]] = values
    return out


def _packed(scale: float):
    """Shards: n, dim, row numbers, ids, components and query flags as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            flat = np.floor(batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
            flags = batch.column(2).to_numpy(zero_copy_only=False).astype(np.uint8)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            for k in range(0, len(ids), SHARD):
                end = min(k + SHARD, len(ids))
                block = _block(flat[offsets[k] : offsets[end]], sizes[k:end])
                rows = np.arange(row, row + end - k, dtype=np.int64)
                row += end - k
                cells = [end - k, block.shape[1], rows.tobytes(), ids[k:end].tobytes(), np.ascontiguousarray(block).tobytes(), flags[k:end].tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, SHARD_TYPES)], names=SHARD_NAMES)

    return run


SHARD_NAMES = ["n", "dim", "rows", "ids", "data", "flags"]
SHARD_TYPES = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]


def _picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per query of the shards: row number, id and components."""
    for batch in batches:
        for r in batch.to_pylist():
            at = np.flatnonzero(np.frombuffer(r["flags"], np.uint8))
            block = np.frombuffer(r["data"]).reshape(r["n"], r["dim"])[at]
            rows, ids = np.frombuffer(r["rows"], np.int64)[at], np.frombuffer(r["ids"], np.int64)[at]
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(ids), pa.array([x.tobytes() for x in block], pa.binary())], names=["row", "id", "data"])


def _tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, len(batch), TILE):
            part = batch.slice(k, TILE)
            data = part.column(2).to_pylist()
            sizes = np.array([len(x) // 8 for x in data])
            block = _block(np.frombuffer(b"".join(data)), sizes)
            cells = [len(part), block.shape[1], part.column(0).to_numpy().tobytes(), part.column(1).to_numpy().tobytes(), np.ascontiguousarray(block).tobytes()]
            names = ["q_n", "q_dim", "q_rows", "q_ids", "q_data"]
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, SHARD_TYPES)], names=names)


def grid(tiles: int, shards: int, cells: int, tile_cost: float = 1.0, shard_cost: float = 1.0) -> tuple[int, int]:
    """Rows (of tiles) and columns (of shards) of a grid with at most ``cells`` cells that copies the fewest bytes:
    each tile goes to all columns, each shard to all rows."""
    best = min(
        ((min(tiles, r), min(shards, max(1, cells // r))) for r in range(1, max(1, min(tiles, cells)) + 1)),
        key=lambda g: (-min(g[0] * g[1], cells // 2), tiles * tile_cost * g[1] + shards * shard_cost * g[0], g),
    )
    return max(1, best[0]), max(1, best[1])


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of ``q`` and ``c`` (whole-valued doubles)."""
    dim = max(q.shape[1], c.shape[1])
    q, c = (np.pad(x, ((0, 0), (0, dim - x.shape[1]))) if x.shape[1] < dim else x for x in (q, c))
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * dim
    if most < 2.0**53:
        return (q @ c.T).astype(np.int64)
    if most < 2.0**62:
        return q.astype(np.int64) @ c.astype(np.int64).T
    whole = lambda x: np.array([[int(v) for v in r] for r in x.tolist()], object).reshape(x.shape)
    return np.clip(whole(q) @ whole(c).T, -LIMIT - 1, LIMIT).astype(np.int64)


def _best(k: int):
    """The k best of each query of a tile in a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q_rows, rows, qi, ci = (np.frombuffer(r[x], np.int64) for x in ("q_rows", "rows", "q_ids", "ids"))
                q = np.frombuffer(r["q_data"]).reshape(len(qi), r["q_dim"])
                c = np.frombuffer(r["data"]).reshape(len(ci), r["dim"])
                order = np.argsort(ci, kind="stable")
                ci, rows, score = ci[order], rows[order], _scores(q, c[order])
                out: list[np.ndarray] = []
                for i in range(len(qi)):
                    s = score[i]
                    ok = np.flatnonzero(rows != q_rows[i])
                    if len(ok) > k:  # all that reach the k-th score, then ties by id, which is the column order
                        t = s[ok]
                        ok = ok[t >= np.partition(t, len(t) - k)[len(t) - k]]
                        ok = ok[np.argsort(-s[ok].astype(object) if s[ok].min() == -LIMIT - 1 else -s[ok], kind="stable")[:k]]
                    out.append(np.stack([np.full(len(ok), q_rows[i]), np.full(len(ok), qi[i]), ci[ok], s[ok], np.full(len(ok), r["col"])]))
                x = np.concatenate(out, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in x], names=["q_row", "query_id", "vec_id", "score", "node"])

    return run


def top_k(vectors: DataFrame, is_query: str, k: int = 10, scale: float = SCALE, vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``k`` best of all other rows of
    ``vectors`` for each row that the SQL condition ``is_query`` picks."""
    spark = vectors.sparkSession
    x = F.col(vector).cast("array<double>")
    sound = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False)))
    flagged = rows.select("vec_id", x.alias("x"), F.coalesce(F.expr(is_query), F.lit(False)).alias("q"))
    shards = staged(map_arrow(flagged, _packed(scale), "n int, dim int, rows binary, ids binary, data binary, flags binary"), "shards")
    queries = map_arrow(shards.select(*SHARD_NAMES), _picked, "row long, id long, data binary")
    queries = staged(queries, "queries")
    size = shards.agg(F.count("*"), F.sum(F.col("n").cast("double") * F.col("dim"))).first()
    wanted = queries.agg(F.count("*"), F.sum(F.length("data") / 8)).first()
    n_tiles = max(1, -(-wanted[0] // TILE))
    tiles = map_arrow(queries.repartition(n_tiles), _tiled, "q_n int, q_dim int, q_rows binary, q_ids binary, q_data binary")
    cells = CELLS * spark.sparkContext.defaultParallelism
    cost = lambda total, n: (total or 0) / max(1, n)
    n_rows, n_cols = grid(n_tiles, max(1, size[0]), cells, cost(wanted[1], n_tiles), cost(size[1], size[0]))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = tiles.withColumn("row", deal("q_rows", n_rows)).withColumn("col", every(n_cols))
    right = shards.drop("flags").withColumn("col", deal("rows", n_cols)).withColumn("row", every(n_rows))
    met = right.join(left.hint("shuffle_merge"), ["row", "col"])
    names = ["q_rows", "q_ids", "q_dim", "q_data", "rows", "ids", "dim", "data", "col"]
    lists = map_arrow(met.select(*names), _best(k), "q_row long, query_id long, vec_id long, score long, node long")

    def merged(rows: DataFrame) -> DataFrame:
        w = Window.partitionBy("q_row", "node").orderBy(F.desc("score"), "vec_id")
        return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    while n_cols > 1:
        n_cols = -(-n_cols // FAN)
        lists = merged(lists.withColumn("node", F.floor(F.col("node") / FAN))).drop("rank")
    return merged(lists).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7(vectors: DataFrame) -> DataFrame:
    return top_k(vectors, "vec_id % 100 = 0")


OP7_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
           FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id AS vec_id,
             CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
      FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 100 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rnk FROM s)
SELECT query_id, CAST(rnk AS INTEGER) AS rank, vec_id, score FROM k WHERE rnk <= 10
"""
