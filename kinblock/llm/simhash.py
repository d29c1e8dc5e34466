"""SimHash near-duplicate classes by pigeonhole blocks.

A text, lower-cased in A-Z, is cut into words (runs of characters other than
space and U+0009-U+000D) and word shingles, repeats included; with fewer
words the whole sequence is the one shingle.  Each shingle is hashed; a
fingerprint bit is set where over half the hashes set it.  Two forms:

*Narrow* (``op10``): 64 bits over 3-word shingles, XXH64 (UTF-8, seed 42) of
the shingle's text, links at RADIUS differing bits or fewer.  The bits are
split into BLOCKS blocks; two fingerprints within RADIUS agree on at least
BLOCKS - RADIUS of them, so the values of every such choice of blocks are the
keys on which candidates meet, and no link can be missed.

*Wide* (``one_of_each``): the same shingles, each different one once, and a
similarity of SIMILARITY or more, the cosine of the sets of shingles that
SimHash estimates (a Jaccard similarity of 2/3).  CHECK bits are compared; the
part of them that differs is the angle over pi.  WIDE_BLOCKS further blocks of
WIDE_BITS bits are the keys: at such a distance no choice of blocks is both
sure and selective, but a pair that differs in a part p of its bits shares a
block with probability 1 - (1 - (1 - p)^WIDE_BITS)^WIDE_BLOCKS: 0.998 at
Jaccard 0.8, 0.96 at 0.75, 0.88 at the limit.  Larger corpora take more and
longer blocks (a bucket holds one in 2^WIDE_BITS of the different texts).

Equal fingerprints are one node.  A bucket of many nodes is dealt into tiles
of at most 2 * TILE of them; every pair of chunks is some tile, so no link is
lost, no task holds a large bucket, and a task returns a spanning forest of
the links in its tiles (fewer rows than nodes), never all pairs.  Lookups by
a hot key (a large class, many equal texts) are split: keys of over one in
HOT of all rows, of which there are fewer than HOT, are broadcast.

Defined results: a text without a word (null, empty, blank) has fingerprint
zero and is linked like any other; very long texts are hashed in chunks, whole;
repeated rows are one node and have one class; rows with a null id keep their
class, whose id is its smallest non-null doc_id (null if there is none); an
empty table gives an empty result; other columns, whatever their names, are
not read (``op10``) or passed through (``one_of_each``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import files, hot_keys, lookup, map_arrow, sized, staged

SHINGLE = 3
RADIUS = 3
BLOCKS = 5
TILE = 1024
SEED = 42
#: The wide form.
SIMILARITY = 0.8
CHECK = 128
WIDE_BLOCKS, WIDE_BITS = 32, 12
WORDS = (CHECK + WIDE_BLOCKS * WIDE_BITS) // 64
WIDE_RADIUS = math.floor(CHECK * math.acos(SIMILARITY) / math.pi)
#: Hashes whose bits are unpacked at a time; links that a task gathers before it reduces them to a forest.
CHUNK = 255 * 64
GATHER = 1 << 18
#: Members of a tile up to which many tiles are compared in one array operation.
SMALL = 128


def _bit_counts(words: np.ndarray) -> np.ndarray:
    """How many rows of ``words`` (n rows of unsigned 64-bit words) set each bit."""
    n, width = words.shape
    total = np.zeros(64 * width, np.int64)
    for k in range(0, n, CHUNK):
        part = np.ascontiguousarray(words[k : k + CHUNK])
        lanes = np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").view(np.uint64)
        full = len(part) // 255  # bytes that count bits hold up to 255 rows, eight of them are added as one integer
        sums = [lanes[: full * 255].reshape(full, 255, 8 * width).sum(axis=1), lanes[full * 255 :].sum(axis=0)[None]]
        total += np.concatenate(sums).view(np.uint8).sum(axis=0, dtype=np.int64)
    return total


def _words(data: bytes) -> list[bytes]:
    return data.lower().split()  # bytes: A-Z only, and splits at the six ASCII white spaces


def fingerprint(data: bytes, size: int = SHINGLE) -> int:
    """The unsigned 64-bit narrow fingerprint of UTF-8 ``data``."""
    import xxhash

    words = _words(data)
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - size + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[size - 1 :].tolist())), np.uint64, n)
    return int(np.packbits(2 * _bit_counts(hashes[:, None]) > n, bitorder="little").view(np.uint64)[0])


_ODD = np.array([2 * k + 1 for k in range(64)], np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of splitmix, a bijection whose bits depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def wide_bits(data: bytes, size: int = SHINGLE) -> np.ndarray:
    """The CHECK + WIDE_BLOCKS * WIDE_BITS bits of the wide fingerprint; words are hashed once and joined by arithmetic."""
    import xxhash

    words = _words(data)
    if not words:
        return np.zeros(64 * WORDS, bool)
    digest = xxhash.xxh64_intdigest
    one = np.fromiter((digest(w, SEED) for w in words), np.uint64, len(words))
    size = min(size, len(words))
    n = len(words) - size + 1
    shingle = np.zeros(n, np.uint64)
    for j in range(size):
        shingle = _mixed(shingle + one[j : j + n])
    shingle = np.unique(shingle)
    total = np.zeros(64 * WORDS, np.int64)
    for k in range(0, len(shingle), CHUNK):
        total += _bit_counts(_mixed(shingle[k : k + CHUNK, None] + _ODD[None, :WORDS]))
    return 2 * total > len(shingle)


def _narrow(column: pa.Array) -> dict[str, pa.Array]:
    out = np.fromiter((fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in column), np.uint64, len(column))
    return {"fp": pa.array(out.view(np.int64))}


def _wide(column: pa.Array) -> dict[str, pa.Array]:
    bits = np.zeros((len(column), 64 * WORDS), bool)
    for k, x in enumerate(column):
        if x.is_valid:
            bits[k] = wide_bits(x.as_buffer().to_pybytes())
    check = np.packbits(bits[:, :CHECK], axis=1, bitorder="little").view(np.int64)
    value = bits[:, CHECK:].reshape(-1, WIDE_BLOCKS, WIDE_BITS) @ (1 << np.arange(WIDE_BITS))
    keys = value + (np.arange(WIDE_BLOCKS) << WIDE_BITS)
    offsets = np.arange(len(column) + 1, dtype=np.int32) * WIDE_BLOCKS
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel().astype(np.int32)))
    return {"fp": pa.array(check[:, 0].copy()), "fp1": pa.array(check[:, 1].copy()), "ks": lists}


def _printed(make, at: int, keep: list[int]):
    """The columns ``keep`` of a batch and the fingerprints of column ``at``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(at)
            made = make(text if text.type in (pa.binary(), pa.large_binary()) else text.cast(pa.binary()))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], *made.values()], names=[*[batch.schema.names[k] for k in keep], *made])

    return run


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and its narrow fingerprint as a signed long ``fp``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return map_arrow(rows, _printed(_narrow, 1, [0]), f"doc_id {kind}, fp long")


def wide_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, the compared bits as longs ``fp`` and ``fp1``, and the block keys ``ks``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return map_arrow(rows, _printed(_wide, 1, [0]), f"doc_id {kind}, fp long, fp1 long, ks array<int>")


def block_keys(blocks: int = BLOCKS, radius: int = RADIUS) -> list[int]:
    """Bit masks of the blocks, and of every choice of ``blocks - radius`` of them."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(masks, blocks - radius)]


def choice_keys(blocks: int = BLOCKS, radius: int = RADIUS) -> Column:
    """array<long>: a hash of each choice of blocks of ``fp`` (equal hashes by chance only add candidates)."""
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    return F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(signed(m)))) for k, m in enumerate(block_keys(blocks, radius))])


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the graph of links (a, b): (node, smallest node joined with it), roots left out."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    up = np.arange(len(nodes))
    while True:
        x, y = up[u], up[v]
        other = x != y
        if not other.any():
            break
        u, v, x, y = u[other], v[other], x[other], y[other]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up, over := up[up]):
            up = over
    inner = np.flatnonzero(up != np.arange(len(nodes)))
    return nodes[inner], nodes[up[inner]]


class _Gathered:
    """Links of a task, reduced to a forest whenever many have come together."""

    def __init__(self) -> None:
        self.a: list[np.ndarray] = []
        self.b: list[np.ndarray] = []
        self.n = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a.append(a)
        self.b.append(b)
        self.n += len(a)
        if self.n > GATHER:
            a, b = self.forest()
            self.a, self.b, self.n = [a], [b], 0  # the forest is counted anew: it may stay as large as the task's nodes

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        none = [np.zeros(0, np.int64)]
        return contract(np.concatenate(self.a or none), np.concatenate(self.b or none))


def _apart(x: list[np.ndarray], i: np.ndarray, j: np.ndarray, radius: int) -> np.ndarray:
    """Whether the fingerprints at ``i`` and ``j`` (any equal shapes) are within ``radius``."""
    d = np.bitwise_count(x[0][i] ^ x[0][j]).astype(np.uint8)
    near = d <= radius
    for w in x[1:]:
        at = np.nonzero(near)
        d[at] += np.bitwise_count(w[i[at]] ^ w[j[at]])
        near[at] = d[at] <= radius
    return near


def _small_tiles(x: list[np.ndarray], start: np.ndarray, size: np.ndarray, radius: int, out: _Gathered) -> None:
    """All pairs within each tile of one chunk, many tiles of a size at a time."""
    node = x[0].view(np.int64)
    for s in np.unique(size).tolist():
        i, j = np.triu_indices(s, 1)
        own = start[size == s]
        step = max(1, (1 << 18) // len(i))
        for k in range(0, len(own), step):
            at = own[k : k + step, None]
            left, right = at + i[None, :], at + j[None, :]
            near = _apart(x, left, right, radius)
            out.add(node[left[near]], node[right[near]])


def _large_tile(x: list[np.ndarray], first: np.ndarray, radius: int, out: _Gathered) -> None:
    """Links of one tile: from each node found so far to the nodes not yet found, until none is left.

    ``first``: the members of the tile's first chunk; if some are not, pairs within a chunk are other tiles'."""
    node = x[0].view(np.int64)
    both = not first.all()
    left = np.arange(len(node))  # not yet found
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            can = left[first[left] != first[at]] if both else left
            d = np.zeros(len(can), np.uint16)
            for w in x:
                d += np.bitwise_count(w[can] ^ w[at])
            found = can[d <= radius]
            if len(found):
                out.add(np.full(len(found), node[at]), node[found])
                queue += found.tolist()
                left = np.setdiff1d(left, found, assume_unique=True)


def _links(radius: int, width: int):
    """Forest of the links in the tiles of a task; rows: key, lo, hi, first and the fingerprint's words, sorted by tile."""

    def tiles(tile: np.ndarray, first: np.ndarray, x: list[np.ndarray], out: _Gathered) -> None:
        start = np.flatnonzero(np.concatenate([[True], (tile[1:] != tile[:-1]).any(axis=1)]))
        size = np.diff(start, append=len(tile))
        plain = np.logical_and.reduceat(first, start)
        small = plain & (size <= SMALL) & (size > 1)
        _small_tiles(x, start[small], size[small], radius, out)
        for a, n in zip(start[~small & (size > 1)].tolist(), size[~small & (size > 1)].tolist()):
            _large_tile([w[a : a + n] for w in x], first[a : a + n], radius, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Gathered()
        held: list[np.ndarray] = []  # the rows of the last tile, which may go on
        for batch in batches:
            if not len(batch):
                continue
            now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4 + width)]
            if held:
                now = [np.concatenate(p) for p in zip(held, now)]
            tile = np.stack([now[0], now[1].astype(np.int64), now[2].astype(np.int64)], axis=1)
            last = int(np.flatnonzero((tile != tile[-1]).any(axis=1))[-1]) + 1 if (tile[0] != tile[-1]).any() else 0
            held = [c[last:] for c in now]
            if last:
                tiles(tile[:last], now[3][:last], [w[:last].view(np.uint64) for w in now[4:]], out)
        if held:
            tile = np.stack([held[0], held[1].astype(np.int64), held[2].astype(np.int64)], axis=1)
            tiles(tile, held[3], [w.view(np.uint64) for w in held[4:]], out)
        a, b = out.forest()
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def links(nodes: DataFrame, keys: Column | None = None, words: tuple[str, ...] = ("fp",), radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) that join the distinct ``fp`` of ``nodes`` as all pairs within ``radius`` that share a key would.

    ``keys``: array of longs (default: those of the narrow form); ``words``: the columns that hold the bits, ``fp`` first.
    """
    keyed = nodes.select(*words, F.explode((choice_keys() if keys is None else keys).cast("array<long>")).alias("key"))
    sizes = keyed.groupBy("key").count().where(F.col("count") > tile)
    large = sizes.select("key", F.ceil(F.col("count") / tile).cast("int").alias("n"))
    if large.isEmpty():  # every bucket is one tile
        tiles = keyed.select("key", F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(True).alias("first"), *words)
    else:
        many = sized(staged(large, "buckets"))
        n = F.coalesce("n", F.lit(1))
        member = keyed.join(many, "key", "left").select("key", n.alias("n"), F.pmod(F.xxhash64("fp"), n).cast("int").alias("c"), *words)
        dealt = member.select("key", "c", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"), *words)
        tiles = dealt.select("key", F.least("c", "j").alias("lo"), F.greatest("c", "j").alias("hi"), (F.col("c") <= F.col("j")).alias("first"), *words)
    by = ["key", "lo", "hi"]
    return map_arrow(tiles.repartition(*by).sortWithinPartitions(*by), _links(radius, len(words)), "a long, b long")


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = _Gathered()
    for batch in batches:
        out.add(batch.column(0).to_numpy(), batch.column(1).to_numpy())
    a, b = out.forest()
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """Rows (node, root) for every node of ``edges`` (a, b); the root is the smallest node of its
    component.  ``rows``: about how many nodes there are, if that is known.

    Each round brings the links of a node, its smaller neighbours, into one
    partition and replaces the links of the partition by a forest of theirs, so
    rows never get more and ends of links only fall.  When nothing changes, every node
    has one link, to its parent in a tree; then parents are replaced by their
    own parents until all are roots.  Where the links are one partition, its forest
    has the roots already, and there are no rounds.
    """

    def reduced(links: DataFrame) -> DataFrame:
        dealt = links.repartition("a")
        dealt = dealt if rows is None else dealt.coalesce(files(rows))  # nodes stay together
        return staged(map_arrow(dealt, _contracted, "a long, b long"), "links")

    def digest(links: DataFrame) -> tuple:
        return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    rooted = lambda links: links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select("b", "b").distinct())
    now = reduced(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    if rows is not None and files(rows) == 1:
        return rooted(now)
    seen = digest(now)
    while seen[0]:
        now = reduced(now)
        if (new := digest(now)) == seen:
            break
        seen = new
    while True:
        above = now.select(F.col("b").alias("a")).distinct().join(now, "a").select(F.col("a").alias("b"), F.col("b").alias("up"))
        if not seen[0] or above.isEmpty():
            break
        above = sized(staged(above, "above", rows))
        now = staged(now.join(above, "b", "left").select("a", F.coalesce("up", "b").alias("b")), "links", rows)
    return rooted(now)


def _classed(
    prints: DataFrame, keys: Column | None = None, words: tuple[str, ...] = ("fp",), radius: int = RADIUS, tile: int = TILE, total: int | None = None
) -> DataFrame:
    """doc_id, fp, and of each row's class the smallest row as ``component_id`` and ``component_fp``; ``total``: the rows, if they are counted."""
    total = prints.count() if total is None else total
    more = [F.min(F.struct(*words[1:], "ks")).alias("more")] if len(words) > 1 else []
    # a null id counts as the largest: classes are named by (is null, id, fingerprint)
    name = F.struct(F.col("least").isNull().alias("z"), "least", "fp").alias("name")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), *more)
    nodes = staged(nodes.select("fp", name, "n", *(["more"] if more else [])), "nodes", total)
    flat = nodes.select("fp", *(["more.*"] if more else []))
    roots = components(links(flat, keys, words, radius, tile), total)
    member = roots.withColumnRenamed("node", "fp").join(nodes.select("fp", "name"), "fp")
    named = member.groupBy("root").agg(F.min("name").alias("first"))
    hot = hot_keys(roots.groupBy("root").agg(F.count("*").alias("n")), "root", total)
    joined = lookup(member.select("fp", "root"), named, "root", hot).select("fp", "first")
    of_node = nodes.select("fp", "name").join(joined, "fp", "left").select("fp", F.coalesce("first", "name").alias("first"))
    of_node = of_node.select("fp", F.col("first.least").alias("component_id"), F.col("first.fp").alias("component_fp"))
    return lookup(prints.select("doc_id", "fp"), of_node, "fp", hot_keys(nodes, "fp", total)).select("doc_id", "fp", "component_id", "component_fp")


def classes(docs: DataFrame, blocks: int = BLOCKS, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """doc_id, fp and component_id for every row of ``docs``, by the narrow form."""
    prints = staged(fingerprints(docs), "fingerprints")
    return _classed(prints, choice_keys(blocks, radius), radius=radius, tile=tile).drop("component_fp")


def wide_classes(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """doc_id, fp, component_id and component_fp for every row of ``docs``, by the wide form."""
    return _wide_classed(staged(wide_fingerprints(docs), "fingerprints"), tile)


def _wide_classed(prints: DataFrame, tile: int = TILE, total: int | None = None) -> DataFrame:
    return _classed(prints, F.col("ks"), ("fp", "fp1"), WIDE_RADIUS, tile, total)


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without near copies by the wide form, its own columns: of each class the row with the
    smallest doc_id stays (ties: the smaller fingerprint; of rows alike in both, any one).  A row
    with a null id stays, as no id tells it from others.

    What goes is joined, not what stays: the ids of the copies are broadcast up
    to a checked number, so that texts need not move.
    """
    prints = staged(wide_fingerprints(docs), "fingerprints")
    total = prints.count()
    copies = _wide_classed(prints, total=total).where("doc_id IS NOT NULL AND (doc_id <> component_id OR fp <> component_fp)")
    if prints.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        gone = sized(staged(copies.select("doc_id"), "copies", total))
        return docs if gone is None else docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    # repeated ids: a row is told by its id and fingerprint
    at = next(k for k, c in enumerate(docs.columns) if c.lower() == "text")
    shape = StructType([*docs.schema.fields, StructField("__fp", LongType())])
    marked = map_arrow(docs, _printed(lambda text: {"__fp": _wide(text)["fp"]}, at, list(range(len(docs.columns)))), shape)
    gone = copies.select(F.col("doc_id").alias("__id"), F.col("fp").alias("__gone")).distinct()
    kept = marked.join(gone, (marked["doc_id"] == gone["__id"]) & (marked["__fp"] == gone["__gone"]), "left_anti")
    some = kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "__fp"])
    return some.unionByName(kept.where("doc_id IS NULL")).select(*docs.columns)


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op10(docs: DataFrame) -> DataFrame:
    return classes(docs.select("doc_id", "text")).select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")
