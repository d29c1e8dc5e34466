"""Byte-level BPE encoding and decoding by a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary's byte strings gives the
id of a pre-token that is itself a token (a compare confirms the hit).  Tier
two: the other pre-tokens are merged by rank with a heap over linked bytes.
Results of both are remembered per worker, up to a bound.  Bytes decode
exactly as encoded.

Defined results: a null or empty text has no ids (digests of no bytes); very
long texts are encoded whole, slice by slice; equal ranks merge from the left;
repeated rows, and rows with a null id, are encoded one by one; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import map_arrow
from .tokenfile import list_array
from .tokens import Encoder, Ranges, column_bytes, flattened, pattern_ranges, tokenizer_path

MODEL = "byte_bpe_multi_50k.tiktoken"


class PerfectHash:
    """Minimal perfect hash by hash and displace: n keys, n places, one number per bucket."""

    PER_BUCKET = 2

    def __init__(self, keys: list[bytes]):
        self.n = n = max(1, len(keys))
        self.buckets = m = -(-n // self.PER_BUCKET)
        hashes = [xxhash.xxh3_128_intdigest(k) for k in keys]
        groups: dict[int, list[int]] = {}
        for i, h in enumerate(hashes):
            groups.setdefault(self._bucket(h), []).append(i)
        self.shift = [0] * m
        self.place = [-1] * n
        free = bytearray(b"\1") * n
        singles = []
        for b, members in sorted(groups.items(), key=lambda g: -len(g[1])):
            if len(members) == 1:
                singles.append((b, members[0]))
                continue
            d = 0
            while True:
                spots = {self._spot(hashes[i], d) for i in members}
                if len(spots) == len(members) and all(free[s] for s in spots):
                    break
                d += 1
            self.shift[b] = d
            for i in members:
                s = self._spot(hashes[i], d)
                self.place[s], free[s] = i, 0
        rest = (s for s in range(n) if free[s])
        for b, i in singles:  # a bucket of one names its place outright
            s = next(rest)
            self.place[s], self.shift[b] = i, -s - 1
        self.keys = [keys[i] if i >= 0 else b"" for i in self.place]

    def _bucket(self, h: int) -> int:
        return (h >> 96) % self.buckets

    def _spot(self, h: int, d: int) -> int:
        return ((h & 0xFFFFFFFF) + d * (1 + ((h >> 32) & 0xFFFFFFFF)) + d * d) % self.n

    def get(self, key: bytes) -> int:
        """The index of ``key`` among the keys, or -1."""
        h = xxhash.xxh3_128_intdigest(key)
        d = self.shift[self._bucket(h)]
        s = -d - 1 if d < 0 else self._spot(h, d)
        return self.place[s] if self.keys[s] == key else -1


def merge(word: bytes, rank: dict[bytes, int]) -> list[int]:
    """Ids of ``word``: the adjacent pair of lowest rank merges first, ties from the left."""
    n = len(word)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = []
    get = rank.get
    for i in range(n - 1):
        if (r := get(word[i : i + 2])) is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue  # one of the two has changed since
        alive[j] = False
        end[i] = stop
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := get(word[i : end[k]])) is not None:
                heapq.heappush(heap, (r, i, end[k]))
        if (p := before[i]) >= 0 and (r := get(word[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(rank[word[i : end[i]]])
        i = after[i]
    return out


class Model:
    """A vocabulary of byte strings with ranks as ids; ``ranges``: the character classes of its pattern."""

    def __init__(self, ranks: dict[bytes, int], ranges: Ranges):
        self.rank = ranks
        tokens = list(ranks)
        self.hash = PerfectHash(tokens)
        self.id_of = [ranks[t] for t in tokens]
        size = max(ranks.values(), default=-1) + 1
        self.bytes_of = [b""] * size
        for t, i in ranks.items():
            self.bytes_of[i] = t
        self.raw = _Table(self.bytes_of)
        self.decimal = _Table([b"%d," % i for i in range(size)])
        self.encoder = Encoder(self._encode, ranges)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for w in words:
            b = w.encode()
            k = self.hash.get(b)
            out.append([self.id_of[k]] if k >= 0 else merge(b, self.rank))
        return flattened(out)


class _Table:
    """Byte strings by id, to be strung together by array operations."""

    def __init__(self, rows: list[bytes]):
        self.size = np.fromiter(map(len, rows), np.int64, len(rows))
        self.begin = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(rows), np.uint8)

    def strung(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The rows of ``ids`` one after another, and the end of each."""
        size = self.size[ids]
        end = np.cumsum(size)
        if not len(ids):
            return b"", end
        return self.flat[np.repeat(self.begin[ids] - end + size, size) + np.arange(end[-1])].tobytes(), end


_LOADED: dict[str, Model] = {}


def load(name: str, ranges: Ranges | None = None) -> Model:
    """The model of a tiktoken file, one a process; ``ranges``: ``pattern_ranges()``, asked for here if not given."""
    if name not in _LOADED:
        with open(tokenizer_path(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _LOADED[name] = Model(ranks, ranges or pattern_ranges())
    return _LOADED[name]


def _encoded(model: str, ranges: Ranges):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(model, ranges).encoder
        for batch in batches:
            done = 0
            for n, ids, sizes in encoder.texts(column_bytes(batch.column(1))):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, n), list_array(ids, sizes)], names=["doc_id", "ids"])
                done += n

    return run


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and the ids of each text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), _encoded(model, pattern_ranges()), f"doc_id {kind}, ids array<int>")


def decode(model: Model, ids: np.ndarray) -> bytes:
    return model.raw.strung(ids)[0]


def _spans(ends: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], ends])[offsets]


def _digested(model: str, ranges: Ranges):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model, ranges)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            done = 0
            for n, ids, sizes in m.encoder.texts(column_bytes(batch.column(1))):
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                text, ends = m.decimal.strung(ids)
                at = _spans(ends, offsets).tolist()
                listed = [sha(memoryview(text)[a : max(a, b - 1)]) for a, b in zip(at, at[1:])]
                text, ends = m.raw.strung(ids)
                at = _spans(ends, offsets).tolist()
                decoded = [sha(memoryview(text)[a:b]) for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(done, n), pa.array(sizes, pa.int64()), pa.array(listed), pa.array(decoded)],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
                done += n

    return run


def op6(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Encodes every text and decodes the ids; both are reduced to digests in the worker that has them."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_arrow(docs.select("doc_id", "text"), _digested(model, pattern_ranges()), shape)
